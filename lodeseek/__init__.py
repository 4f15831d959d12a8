"""Spark-first document search and analytics engine."""
