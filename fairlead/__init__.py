"""Spark-native analytics over ship-position data."""
