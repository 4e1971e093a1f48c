"""Windowed aggregation of streams into fragments."""
