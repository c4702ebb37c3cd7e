"""Operators of the take-off engine."""
