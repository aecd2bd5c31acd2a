"""Spark-native analytics for cytometry event tables."""

__version__ = "0.1.0"
