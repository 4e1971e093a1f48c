"""Fragments from tables, files and generators."""
