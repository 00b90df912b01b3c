"""Operators of a training-data pipeline: filters, deduplication, scoring, sharding, packing and token files."""
