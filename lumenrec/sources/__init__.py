"""Sources of the recommendation engine."""
