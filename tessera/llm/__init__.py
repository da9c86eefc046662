"""Training-data operators: mixing, extraction, tokenising, language, dedup, licences, personal data."""
