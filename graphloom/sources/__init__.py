"""Primitives from dumps, from appended Parquet, and from relational tables."""
