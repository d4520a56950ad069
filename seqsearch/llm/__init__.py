"""Operators for large text corpora: filtering, counting, near-duplicate removal, mixing, encoding.

Nothing outside this subpackage imports it.
"""
