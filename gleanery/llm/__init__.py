"""Operators for training-data corpora: near-duplicates, token counts, filters, mixing, search, scoring and encoding.

Nothing else in the library imports this subpackage.
"""
