"""Spark-first analytics over time-series bars."""
