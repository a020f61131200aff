"""glyphloom: a PySpark-native engine for spatial and single-cell count data."""

__version__ = "0.1.0"
