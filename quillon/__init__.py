"""quillon: a PySpark-native engine for sequence, profile and coordinate data."""

__version__ = "0.1.0"
