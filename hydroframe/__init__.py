"""PySpark-native engine for sampled 16-bit signals and training-data corpora."""

__version__ = "0.1.0"
