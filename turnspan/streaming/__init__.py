"""streaming of the turnspan engine."""
