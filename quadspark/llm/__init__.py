"""Operators for large text and embedding corpora.  Nothing outside this package imports it."""
