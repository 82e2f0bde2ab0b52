"""Operators for training-data pipelines: tokens, duplicates, scoring, mixing, search."""
