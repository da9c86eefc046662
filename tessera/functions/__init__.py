"""Column expressions: text, vectors, geometry, scalars."""
