"""Operators for preparing training text: scoring, packing, duplicates, filters, formats."""
