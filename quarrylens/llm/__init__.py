"""Operators for preparing training data: deduplication, filtering, scoring, tokenising and packing.

Nothing else in the library imports this subpackage."""
