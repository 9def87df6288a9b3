"""Lodestone: a PySpark-native engine for code-knowledge and corpus analytics."""

__version__ = "0.1.0"
