"""Structured Streaming variants of the movie folds."""
