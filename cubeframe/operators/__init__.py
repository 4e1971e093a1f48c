"""Relational operators on fragments."""
