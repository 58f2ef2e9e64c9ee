"""Spark-first analytics for directional order flow in event-driven trade streams."""
