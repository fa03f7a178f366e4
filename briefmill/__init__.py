"""Spark-native analytics over collections of documents and the entities around them."""
