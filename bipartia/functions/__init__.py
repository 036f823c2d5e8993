"""Column functions: text folding, vectors."""
