"""Operators on graphs held as DataFrames."""
