"""End-to-end plans: adapter onto the given tables, matrix assembly, query registry, SQL oracles."""
