"""Training-data operators: quality, safety, deduplication, decontamination, extraction and mixing.

Nothing else in the library imports this subpackage.
"""
