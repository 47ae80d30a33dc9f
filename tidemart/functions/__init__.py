"""Column expressions and JSON parsing."""
