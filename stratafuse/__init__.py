"""Spark-native spatial fusion analytics."""
