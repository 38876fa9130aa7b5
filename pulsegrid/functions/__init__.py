"""Column functions without data access."""
