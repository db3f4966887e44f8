"""Operators on pages, lines and spans."""
