"""Operators for preparing training data: near-duplicates, filters, mixing, sharding and packing."""
