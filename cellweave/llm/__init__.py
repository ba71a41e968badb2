"""Operators for preparing training text: counting, deduplicating, joining, packing, scoring and storing documents."""
