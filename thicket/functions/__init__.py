"""Column expressions, objectives and metrics."""
