"""Column expressions: ratios, flags, recodes, strict aggregates, bins, hashes."""
