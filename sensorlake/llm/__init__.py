"""Operators for preparing training data: deduplication, tokens, archives, filters, mixing and search.

Nothing else in the library imports this package.
"""
