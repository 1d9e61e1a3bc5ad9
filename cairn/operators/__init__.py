"""Operators over DataFrames; each takes and returns DataFrames and never collects rows."""
