"""Operators for text corpora: packing, leakage search and splitting."""
