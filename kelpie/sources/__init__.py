"""Readers that turn text and JSON stores into the logical tables."""
