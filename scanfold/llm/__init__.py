"""Training-data operators: search, archives, packing, tokenizers, chat windows, language ID, secrets, media, deduplication.

Nothing else in the library imports this subpackage.
"""
