"""Spark-native duplicate and similarity analytics."""
