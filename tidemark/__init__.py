"""Tidemark: a PySpark-native engine for online change-point scoring of many univariate series."""
