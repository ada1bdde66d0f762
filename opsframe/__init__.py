"""Operational event analytics as Spark DataFrame operators."""
