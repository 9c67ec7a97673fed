"""Column-level helper functions."""
