"""Spark-native engine for shared, append-only agent memory."""
