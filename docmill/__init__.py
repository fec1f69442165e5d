"""A Spark-native engine that prepares documents and tables for language models."""

__version__ = "0.1.0"
