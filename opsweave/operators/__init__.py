"""Operators over operational tables: DataFrames in, DataFrames out. Windows are [start, end) in microseconds."""
