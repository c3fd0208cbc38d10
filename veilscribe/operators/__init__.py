"""Operators on DataFrames, built from the column expressions."""
