"""Column functions and numeric tables."""
