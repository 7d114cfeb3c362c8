"""Recommendation analytics on Spark: every operator is a lazily composed DataFrame expression."""
