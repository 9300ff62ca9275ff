"""Operators over DataFrames; each returns a DataFrame or a small object made of aggregates."""
