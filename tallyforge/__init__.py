"""tallyforge: a PySpark-native engine for demand analytics and event data processing."""

__version__ = "0.1.0"
