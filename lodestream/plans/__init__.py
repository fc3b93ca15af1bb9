"""Feature plans: which groups of columns to compute, in which order."""
