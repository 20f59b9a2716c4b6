"""Column types and scalar conversions."""
