"""Operators for preparing training text: extraction, packing, tokens, language,
deduplication, search, quality and archives.

Nothing outside this package imports it.
"""
