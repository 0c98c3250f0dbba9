"""Column functions: extraction from records, and the conversions of values."""
