"""Column functions and vectorised helpers."""
