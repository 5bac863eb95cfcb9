"""Structured documents as typed, queryable Spark tables."""
