"""tessera: a PySpark-native engine for searchable, citable text archives."""

__version__ = "0.1.0"
