"""Operators that prepare training data: fixity, extraction, filtering, deduplication, scoring, sharding and packing."""
