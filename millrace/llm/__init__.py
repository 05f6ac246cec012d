"""Training-data operators: quality, deduplication, archives, packing, decontamination.

Nothing else in the library imports this subpackage.
"""
