"""Searches over arriving files."""
