"""Operators: every function takes and returns DataFrames keyed by an explicit column."""
