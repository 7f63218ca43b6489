"""Spark-native analytics for monitored public-information records."""
