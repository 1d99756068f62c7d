"""Training-data operators: licence scan, quality, language, sharding, search,
tokens, near duplicates, packing and repeated passages.

Nothing else in the library imports this subpackage.
"""
