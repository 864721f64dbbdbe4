"""Operators for preparing training text: duplicates, language, mixing, tokens, chat records, pages and vectors.

Nothing else in the library imports this package.
"""
