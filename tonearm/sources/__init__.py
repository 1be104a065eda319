"""Readers and writers of the library's tables, logs and playlist files."""
