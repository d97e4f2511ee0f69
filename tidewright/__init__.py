"""Spark-native temporal evidence, evaluation and corpus analytics."""
