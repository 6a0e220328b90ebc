"""Repair of malformed JSON that language models write, and schema-directed coercion of what it holds."""
