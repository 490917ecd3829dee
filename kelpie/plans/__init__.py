"""Compositions of operators, and the registry of named queries with their SQL."""
