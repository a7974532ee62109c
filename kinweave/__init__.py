"""Spark-native analysis and synthesis of foreign-key-linked tables."""
