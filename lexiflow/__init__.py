"""Spark-first analytics for language-learning data."""
