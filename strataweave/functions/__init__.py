"""Column functions: text and names, and parsers that turn source text into nested columns."""
