"""Operators on DataFrames: seeds, votes, alignment, constraints, ranking."""
