"""Operators for preparing training text: each is a function from DataFrames to a DataFrame."""
