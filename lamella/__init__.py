"""Spark-native analytics for small, hierarchical measurement data and the corpora around it."""
