"""Operators for preparing training text; see the README for how they scale."""
