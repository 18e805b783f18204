"""Operators for large-scale text corpora, each a DataFrame-to-DataFrame function."""
