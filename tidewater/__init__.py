"""Spark-native operators for two-sided price quotes, point-in-time features and their evaluation."""
