"""Column functions and table functions."""
