"""Plumbline: quantity take-off analytics as Spark DataFrame jobs."""
