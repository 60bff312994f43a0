"""Keelson: a PySpark-native engine for versioned record logs whose layout follows their reads."""

__version__ = "0.1.0"
