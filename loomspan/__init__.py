"""Spark-native analytics over collections of independently published web pages."""
