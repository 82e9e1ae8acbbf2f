"""Operators for training data: deduplication, classification, scans, formatting, mixing, packing."""
