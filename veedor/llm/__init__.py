"""Operators for large text collections: extraction, deduplication, scoring, tokenisation."""
