"""Data-protection and usage-governance analytics, as functions from DataFrames to DataFrames."""
