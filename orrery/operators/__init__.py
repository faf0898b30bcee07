"""Operators on triples and graphs, each from DataFrames to a DataFrame."""
