"""Column expressions: values, text, similarity, formatting."""
