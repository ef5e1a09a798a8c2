"""Spark-native evidence-agreement and corpus-processing engine."""

__version__ = "0.1.0"
