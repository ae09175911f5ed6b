"""Operators for preparing training text: fingerprints, deduplication, scoring, packing and output."""
