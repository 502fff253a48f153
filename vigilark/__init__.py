"""Spark-native preparation and validation of surveillance tables."""

__version__ = "0.1.0"
