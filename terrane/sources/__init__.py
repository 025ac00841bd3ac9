"""Readers, writers and fixture graphs."""
