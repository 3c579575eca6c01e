"""Readers, writers and integrity checks."""
