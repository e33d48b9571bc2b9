"""Operators on tables: each takes DataFrames and returns DataFrames."""
