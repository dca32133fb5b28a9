"""Operators on DataFrames, grouped by stage."""
