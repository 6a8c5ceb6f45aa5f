"""Driver-side planning: schema and plan model, inference, order, DDL."""
