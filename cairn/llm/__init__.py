"""Operators for preparing training text: each module has one operator and its query."""
