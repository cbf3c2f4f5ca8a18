"""Provenance of numbers, dates and durations as Spark jobs."""
