"""Spark-native data quality engine: profiling, cleaning, validation and text preparation."""

__version__ = "0.1.0"
