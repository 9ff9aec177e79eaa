"""Column expressions: predicates, row filters, search, identifiers."""
