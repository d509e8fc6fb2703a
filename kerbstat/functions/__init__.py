"""Column expressions: text, clock, calendar and place."""
