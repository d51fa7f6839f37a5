"""The row functions on streaming DataFrames."""
