"""Spark-native analytics over irregular event sequences and populations of embedded entities."""
