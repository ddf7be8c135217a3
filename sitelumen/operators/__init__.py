"""Operators on DataFrames that the plans are built from."""
