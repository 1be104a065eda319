"""Column helpers: vectors, keys, text."""
