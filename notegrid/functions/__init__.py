"""Column functions and vectorized helpers."""
