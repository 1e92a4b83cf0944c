"""Operators for preparing training text: search, filters, tokens, secrets, duplicates, extraction."""
