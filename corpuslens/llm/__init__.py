"""Training-data pipeline operators: each is a function from DataFrames to a DataFrame.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
