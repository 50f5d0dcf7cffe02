"""Column functions: text, markdown, identity."""
