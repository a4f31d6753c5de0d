"""Column expressions: exact sums, text numbers and dates, Brazilian formatting."""
