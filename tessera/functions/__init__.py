"""Column expressions over boxes, scores and paths."""
