"""Column functions: labels, parsers and vector arithmetic."""
