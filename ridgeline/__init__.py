"""Ridgeline: a PySpark-native engine for temporal evidence tables."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
