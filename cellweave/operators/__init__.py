"""Operators: pure functions from DataFrames (plus a config) to DataFrames."""
