"""Plans of the recommendation engine."""
