"""Operators for preparing large text and embedding corpora for model training."""
