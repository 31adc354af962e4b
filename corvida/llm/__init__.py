"""Training-data operators: quality, near-duplicates, mixing, language, secrets, web records, packing, chat,
periodic runs, tokens, vector codes.

Nothing else in the library imports this subpackage.
"""
