"""Operators over the store's tables, each a function from frames to frames."""
