"""tierlink: a PySpark-native engine for two-tier knowledge graphs over document corpora."""

__version__ = "0.1.0"
