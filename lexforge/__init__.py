"""Spark-native document retrieval, evaluation and data preparation engine."""
