"""Column functions: text, vectors, embedders."""
