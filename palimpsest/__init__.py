"""Spark-first de-identification and text processing engine."""
