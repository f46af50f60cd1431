"""Operators: pure functions from DataFrames and parameters to DataFrames."""
