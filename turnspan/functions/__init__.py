"""functions of the turnspan engine."""
