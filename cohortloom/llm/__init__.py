"""Training-data operators: sharding, search, quality, tokenizing, dedup, scoring, packing.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
