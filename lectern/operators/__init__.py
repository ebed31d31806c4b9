"""Operators on DataFrames: each takes tables and gives a table; none reads files or runs a job by itself."""
