"""sources of the turnspan engine."""
