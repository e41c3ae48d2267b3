"""Column expressions; none is a user-defined function."""
