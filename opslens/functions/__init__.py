"""Column expressions: reading dirty text, rounding, exact money sums, display text."""
