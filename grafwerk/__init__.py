"""Spark-native analytics for property graphs of source code and their documents."""
