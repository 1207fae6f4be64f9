"""Spark-first analytics over intervals, counts and events."""

__version__ = "0.1.0"
