"""The analysis operators. Each takes DataFrames and returns a DataFrame."""
