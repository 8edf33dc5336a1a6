"""Operators for preparing training text: packing, deduplication, tokenising, chat formatting and classification."""
