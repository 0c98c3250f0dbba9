"""Operators over records and tables: DataFrames in, DataFrames out."""
