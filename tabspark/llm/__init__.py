"""Operators for building training data: tokens, packing, filters, near-duplicates, private data."""
