"""Operators for preparing training corpora: deduplication, extraction, scoring, mixing, packing."""
