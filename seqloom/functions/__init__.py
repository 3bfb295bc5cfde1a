"""Biological sequence records as DataFrames."""
