"""Training-data operators: filtering, deduplication, tokenising, archiving, scoring, search and packing.

Nothing outside this package imports it.
"""
