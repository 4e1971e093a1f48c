"""Primitives on arrays and row keys, as Column builders."""
