"""Spark-native text-corpus preparation, sampling and scoring."""
