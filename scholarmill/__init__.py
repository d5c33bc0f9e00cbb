"""Spark-native analytics for scholarly text corpora."""
