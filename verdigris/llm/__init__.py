"""Operators that prepare training text: quality, deduplication, mixing and packing."""
