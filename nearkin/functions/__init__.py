"""Column expressions over vectors and text."""
