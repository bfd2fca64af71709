"""Operators for preparing training text: cleaning, deduplication, mixing, scoring and layout."""
