"""Column functions: text, patterns and fixed word lists."""
