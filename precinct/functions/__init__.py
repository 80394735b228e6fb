"""Column helpers: predicates, scalars and calendar expressions."""
