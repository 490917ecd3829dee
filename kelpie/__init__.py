"""Spark-native analytics over knowledge-memory tables: documents, turns, calendars and a weighted entity graph."""
