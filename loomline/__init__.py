"""Loomline: a Spark-native engine for curating nested conversation datasets."""
