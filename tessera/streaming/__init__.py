"""Windows over event time, in batch and as Structured Streaming."""
