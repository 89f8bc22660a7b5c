"""Operators for preparing training data: similarity search, grouping, splits, leakage, tokens and redaction."""
