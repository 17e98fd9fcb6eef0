"""A Spark-native engine for multi-temporal raster and field analytics."""

__version__ = "0.1.0"
