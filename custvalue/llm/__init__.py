"""Operators of a training-data pipeline: search, extraction, tokens, near-duplicates, classifiers, packing."""
