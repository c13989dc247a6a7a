"""Operators for preparing training data: licences, personal data, near duplicates, pages, secrets,
benchmark leaks, vector search, mixing, web archives and quality. ``queries`` registers them."""
