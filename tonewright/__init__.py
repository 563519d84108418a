"""tonewright: a Spark-native engine for building and judging text style-transfer data."""

__version__ = "0.1.0"
