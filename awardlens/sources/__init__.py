"""Readers, writers and the declared schema."""
