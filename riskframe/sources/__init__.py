"""Readers, writers and column naming."""
