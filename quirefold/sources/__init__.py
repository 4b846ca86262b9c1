"""Readers, writers and the chunk store."""
