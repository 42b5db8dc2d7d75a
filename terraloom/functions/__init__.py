"""Column functions: geometry, scores and vectors."""
