"""Column expressions and the fixed tables they look values up in."""
