"""Lumenlit: a PySpark-native engine for scientific-literature analytics."""

__version__ = "0.1.0"
