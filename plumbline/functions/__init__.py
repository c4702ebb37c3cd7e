"""Functions of the take-off engine."""
