"""Column-expression builders and fixed value lists."""
