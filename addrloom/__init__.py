"""Spark-native resolution of hierarchical addresses, and the query plans around it."""
