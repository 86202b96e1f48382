"""Operators that prepare training text: fingerprints, tokens, filters, near duplicates, packing."""
