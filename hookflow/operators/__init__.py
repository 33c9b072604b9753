"""Batch operators, one module per concern; each function maps DataFrames to a DataFrame."""
