"""Column expressions: keyed randomness, vectors, statistics, image bytes."""
