"""Column functions: collation keys, word patterns, rendered ids and timestamps."""
