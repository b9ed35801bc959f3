"""Spark-native analytics over annotated sparse matrices."""
