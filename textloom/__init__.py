"""Spark-native engine for content-visibility metrics and training data."""
