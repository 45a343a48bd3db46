"""Spark-native consensus rankings and catalog analytics."""
