"""Spark-native retrieval over documentation and code."""
