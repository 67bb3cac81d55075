"""Training-data operators (deduplication, mixing, packing, filtering, scans).

Nothing else in the library imports this subpackage.
"""
