"""operators of the turnspan engine."""
