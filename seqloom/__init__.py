"""Biological sequence analytics on Spark DataFrames.

Records are rows (file_ord, ord, id, desc, seq, qual); (file_ord, ord) is the input order, which sorting, deduplication,
splitting and search keep to. Every operator takes and returns DataFrames.
"""
