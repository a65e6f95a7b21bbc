"""Readers, writers and the panels derived from the given tables."""
