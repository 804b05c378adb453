"""Spark-native memory retrieval and analytics."""
