"""Declared queries over the standard tables."""
