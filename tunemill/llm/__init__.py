"""Operators for large training-data corpora: search, de-duplication, mixing, scoring, scanning and encoding."""
