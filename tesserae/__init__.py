"""Spark-native analytics for ragged numeric records and token corpora."""

__version__ = "0.1.0"
