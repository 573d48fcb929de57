"""Retail and evaluation analytics as Spark DataFrame operators."""
