"""Spark-native analytics for ordered, ball-by-ball style event data."""
