"""Flood-risk and grid-impact analytics as Spark DataFrame operators."""
