"""Operators that prepare training text: duplicates, leaks, quality, personal data, tokens, packing."""
