"""Column functions: scoring, text, predicates, JSON."""
