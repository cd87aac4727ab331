"""Plumbline: Spark-native analytics for evaluating language-model outputs."""

__version__ = "0.1.0"
