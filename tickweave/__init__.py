"""Spark-native operators for exchange tick and trade data."""

__version__ = "0.1.0"
