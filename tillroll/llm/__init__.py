"""Operators for training-data pipelines: filters, deduplication, extraction, tokenisation, search and sharding."""
