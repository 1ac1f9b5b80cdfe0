"""Column functions: pure expressions over paths, numbers and names."""
