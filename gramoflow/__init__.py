"""gramoflow: Spark-native analytics for large, messy catalog and text data."""

__version__ = "0.1.0"
