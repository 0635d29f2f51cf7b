"""Knotwork: a PySpark-native knowledge-graph analytics engine."""

__version__ = "0.1.0"
