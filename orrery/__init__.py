"""Spark-native analytics for typed business-model graphs."""
