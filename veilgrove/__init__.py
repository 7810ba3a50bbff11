"""PySpark-native engine for vertically partitioned tree learning and its analysis."""

__version__ = "0.1.0"
