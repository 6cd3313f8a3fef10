"""Operators on sets of ids, writes, and integrity checks."""
