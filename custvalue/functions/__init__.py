"""Column expressions and the ordered-aggregation building blocks."""
