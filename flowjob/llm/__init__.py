"""Operators for preparing training text: filters, deduplication, scoring, extraction, packing.

Nothing else in the library imports this subpackage.
"""
