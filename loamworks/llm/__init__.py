"""Operators for large-scale text preparation; nothing outside this package imports it."""
