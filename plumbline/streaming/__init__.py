"""Streaming of the take-off engine."""
