"""Column expressions: tokens, hashes, n-grams and vectors."""
