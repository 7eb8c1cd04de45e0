"""Operators of a training-data pipeline: scoring, encoding, packing, quality rules, deduplication, toxicity."""
