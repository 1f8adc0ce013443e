"""millrace: a PySpark-native engine for evaluation records of generated tests and training-data preparation."""

__version__ = "0.1.0"
