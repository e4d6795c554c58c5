"""Readers of request files and the stored graph tables."""
