"""Operators: DataFrames in, DataFrame out, every column named by the caller."""
