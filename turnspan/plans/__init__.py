"""plans of the turnspan engine."""
