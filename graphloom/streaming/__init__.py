"""Structured Streaming over the append log of primitives."""
