"""Deterministic, token-budgeted context preparation as Spark DataFrames."""
