"""Spark-native document preparation: acquire, parse, normalise, split, deliver."""

__version__ = "0.1.0"
