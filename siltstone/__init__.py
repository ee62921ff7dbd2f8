"""Siltstone: a PySpark-native engine for preparing and analysing text corpora."""
