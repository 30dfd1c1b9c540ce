"""Operators for training-data pipelines: scoring, filtering, deduplication, extraction and packing of texts."""
