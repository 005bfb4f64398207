"""Footage-library analytics as Spark DataFrame operators."""
