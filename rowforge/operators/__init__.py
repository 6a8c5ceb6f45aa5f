"""DataFrame operators: checks, relations, uniqueness, generation, export."""
