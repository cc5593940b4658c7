"""Operators for preparing training text; nothing else here imports them."""
