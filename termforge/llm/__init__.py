"""Operators for building training text: quality, near-duplicates, boilerplate, encodings, term statistics, tokens, leaks and personal data."""
