"""Training-data operators: quality, deduplication, decontamination, privacy, tokens, archives.

Nothing else in the library imports this subpackage.
"""
