"""Column expressions: normalisation, dates, labels and predicates."""
