"""Column expressions and the fixed values they look up."""
