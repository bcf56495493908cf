"""Operators on DataFrames: joins, aggregations and windows."""
