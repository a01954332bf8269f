"""framequarry: a PySpark-native engine for indexed frame, detection and document tables."""

__version__ = "0.1.0"
