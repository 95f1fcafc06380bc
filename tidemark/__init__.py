"""Spark-native time-series and market-data analytics."""
