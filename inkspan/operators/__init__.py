"""Operators: DataFrames and parameters in, DataFrame out."""
