"""Sorted-exchange analytics on PySpark: DataFrame-first, no custom execution engine."""

__version__ = "0.1.0"
