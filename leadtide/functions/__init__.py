"""Column expressions: calendar, text, numbers, metrics."""
