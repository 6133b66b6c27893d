"""Spark-native document, retrieval, guardrail and operations analytics."""

__version__ = "0.1.0"
