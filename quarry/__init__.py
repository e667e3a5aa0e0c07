"""Spark-native analytics over plain-text database dumps."""
