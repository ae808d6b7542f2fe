"""Readers and logical tables."""
