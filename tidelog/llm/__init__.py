"""Operators for training data: mixing, scoring, filtering, extraction, encoding and deduplication."""
