"""Operators that prepare training data for language models: dedup, quality, scoring, mixing, packing."""
