"""Spark-native windowed signal analysis, table expressions, interpolation and linear algebra."""
