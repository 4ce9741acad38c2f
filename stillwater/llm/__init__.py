"""Operators for large text corpora."""
