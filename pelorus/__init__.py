"""pelorus: a PySpark-native engine for versioned data pipelines and analytics."""

__version__ = "0.1.0"
