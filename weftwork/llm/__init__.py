"""Training-data operators: quality, deduplication, mixing, packing, sharding and chat formatting.

Nothing outside this subpackage imports it.
"""
