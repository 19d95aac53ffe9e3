"""Operators for preparing text corpora: deduplication, filtering, scoring and tokenising at scale."""
