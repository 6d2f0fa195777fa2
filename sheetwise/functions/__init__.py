"""Column expressions on drawing values."""
