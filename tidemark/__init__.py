"""Spark-native analytics for rumour threads and coordinated posting."""

__version__ = "0.1.0"
