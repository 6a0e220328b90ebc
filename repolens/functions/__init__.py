"""Scalar functions as Column expressions, their vocabularies, and repair of malformed JSON."""
