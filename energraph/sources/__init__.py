"""Readers, writers and the table layout of an index."""
