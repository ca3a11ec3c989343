"""Column expressions: parsing, names, flags."""
