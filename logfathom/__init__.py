"""Spark-native analytics for diagnostic log bundles."""

__version__ = "0.1.0"
