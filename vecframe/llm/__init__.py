"""Training-data operators: archives, deduplication, filters, mixing, tokens and media.

Nothing else in the library imports this subpackage.
"""
