"""Variant analytics and training-data preparation as plain PySpark DataFrame operators."""

__version__ = "0.1.0"
