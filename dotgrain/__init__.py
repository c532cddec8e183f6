"""Relational image screening on Spark."""
