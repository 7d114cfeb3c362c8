"""Operators of the recommendation engine."""
