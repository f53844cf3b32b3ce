"""Operators over reads, as functions from DataFrames to DataFrames."""
