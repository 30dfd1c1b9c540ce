"""Operators over one table."""
