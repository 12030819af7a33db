"""Operators on text collections."""
