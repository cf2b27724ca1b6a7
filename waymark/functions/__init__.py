"""Column-only functions: geodesy, text, numbers."""
