"""Spark-native engine for multi-view geometry tables."""
