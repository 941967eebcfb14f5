"""Structured Streaming folds of the append-only journals."""
