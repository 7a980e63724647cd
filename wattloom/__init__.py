"""Spark-native time-series, knowledge-base and retrieval analytics."""
