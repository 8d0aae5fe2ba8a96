"""Spark-native analytics for annotated, quotation-bearing text corpora."""

__version__ = "0.1.0"
