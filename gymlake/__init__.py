"""Spark-native analytics over agent-evaluation data."""
