"""Column functions: text, statistics."""
