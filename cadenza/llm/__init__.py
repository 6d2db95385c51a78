"""Operators that prepare training data: deduplication, filtering, mixing, formatting, packing.

Nothing else in the library imports this subpackage.
"""
