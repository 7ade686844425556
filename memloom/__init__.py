"""memloom: a PySpark-native memory retrieval and analytics engine."""

__version__ = "0.1.0"
