"""Spark-native analytics over newspaper publication data."""
