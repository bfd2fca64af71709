"""Operators: every function takes and returns DataFrames and runs over many clouds at once."""
