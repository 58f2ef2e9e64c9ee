"""Operators: each takes and returns DataFrames and changes nothing in place."""
