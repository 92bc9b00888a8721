"""kartei: a PySpark-native engine that catalogues files, extracts their metadata and searches the result."""

__version__ = "0.1.0"
