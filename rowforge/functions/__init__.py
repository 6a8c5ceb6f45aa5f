"""Column-returning functions: draws, value kinds, patterns, scalars."""
