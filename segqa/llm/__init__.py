"""Operators of a training-data pipeline: deduplication, filtering, sharding, formatting, packing, tokens.

Optional: nothing else in the library imports this subpackage.
"""
