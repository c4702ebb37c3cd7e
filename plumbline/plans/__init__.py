"""Plans of the take-off engine."""
