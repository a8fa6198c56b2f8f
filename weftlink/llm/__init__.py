"""Training-data pipeline operators: mixing, packing, deduplication, search and formatting.

Nothing outside this subpackage imports it.
"""
