"""Part of the decision-analytics library."""
