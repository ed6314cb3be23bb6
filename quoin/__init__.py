"""Spark-native engine for line-level text-recognition datasets."""
