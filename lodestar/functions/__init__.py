"""Column functions: text and numbers, as built-in expressions only."""
