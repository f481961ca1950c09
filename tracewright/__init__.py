"""Spark-native analytics for investigating document collections and the figures in them."""
