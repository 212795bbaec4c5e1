"""Operators over trace tables: DataFrames in, a lazy DataFrame out."""
