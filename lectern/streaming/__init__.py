"""Structured Streaming forms of the merges."""
