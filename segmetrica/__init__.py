"""Segment-level detector analytics as Spark DataFrame operators."""
