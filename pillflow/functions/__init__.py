"""Column builders: predicates, scalar helpers and message texts."""
