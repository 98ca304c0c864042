"""The data work, as functions from DataFrames to DataFrames."""
