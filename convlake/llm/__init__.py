"""Operators for preparing training text: near copies, mixing, secrets, scoring, packing."""
