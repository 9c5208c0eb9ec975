"""Spark-native analytics for market, fundamentals, portfolio and fund data."""
