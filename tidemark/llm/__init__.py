"""Operators for large text corpora: scoring, duplicate removal, filtering, mixing, encoding, search."""
