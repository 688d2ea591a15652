"""Operators for preparing training text: deduplication, tokenization, scoring, extraction and packing.

Nothing else in the package imports this subpackage.
"""
