"""Spark-native processing of map data."""
