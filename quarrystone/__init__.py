"""A PySpark-native analytics engine for estates of mainframe source code."""

__version__ = "0.1.0"
