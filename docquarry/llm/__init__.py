"""Operators for preparing training corpora: deduplication, filtering, tokenising, scoring."""
