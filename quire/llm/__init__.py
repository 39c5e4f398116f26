"""Corpus preparation operators: tokens, quality, duplicates, privacy, packing, search.

Nothing outside this subpackage imports it.
"""
