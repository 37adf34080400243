"""Operators for large training-data pipelines: deduplication, filtering, mixing, packing, extraction, archives."""
