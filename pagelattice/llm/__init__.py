"""Operators for preparing training text: similarity joins, filters, encoders, archives.

Nothing outside this subpackage imports it.
"""
