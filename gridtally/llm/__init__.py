"""Operators for preparing training data: filtering, deduplication, scoring, extraction, packing."""
