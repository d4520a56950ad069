"""Whole searches and the catalogue of queries."""
