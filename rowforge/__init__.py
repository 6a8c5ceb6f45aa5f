"""Schema-aware synthetic data and data checks as Spark plans."""
