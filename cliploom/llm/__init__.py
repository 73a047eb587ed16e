"""Operators for large text corpora: one module each, plus their registry of queries."""
