"""quantloom: a PySpark-native engine for panel time series and text signals."""

__version__ = "0.1.0"
