"""Column builders; see exprs."""
