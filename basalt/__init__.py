"""PySpark-native table operators with strict, documented semantics."""

__version__ = "0.1.0"
