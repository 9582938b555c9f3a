"""Column and SQL-text functions."""
