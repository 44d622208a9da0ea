"""Readers, writers and reply providers."""
