"""Operators for large text corpora and embedding tables."""
