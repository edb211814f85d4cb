"""Operators for preparing training text at scale: filters, deduplication, tokens, packing, media."""
