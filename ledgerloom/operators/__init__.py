"""Operators on record tables: DataFrames in, DataFrames out."""
