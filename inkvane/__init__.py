"""Spark-native text-revision analytics and training-data operators."""
