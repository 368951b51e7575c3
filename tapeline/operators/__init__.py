"""Operators on decoded topics."""
