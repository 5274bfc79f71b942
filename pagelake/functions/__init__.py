"""Column functions: geometry of boxes, and rules on languages, texts and paths."""
