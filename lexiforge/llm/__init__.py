"""Operators for large text corpora: cleaning, deduplication, scoring, mixing and sharding."""
