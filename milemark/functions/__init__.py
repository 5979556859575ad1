"""Column expressions: text, keys, calendar and rules."""
