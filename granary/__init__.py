"""granary: a PySpark-native engine for grounded retrieval over web documents."""

__version__ = "0.1.0"
