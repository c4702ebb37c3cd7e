"""Sources of the take-off engine."""
