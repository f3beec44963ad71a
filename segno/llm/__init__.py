"""Operators for large text corpora that are prepared as training data."""
