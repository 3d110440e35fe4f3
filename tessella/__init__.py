"""Tessella: a PySpark-native engine for corpus data."""
