"""Operators for preparing training text: mixing, filtering, extraction, tokens, duplicates, language, privacy, scoring.

Nothing else in the library imports this package.
"""
