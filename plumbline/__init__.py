"""Spark-native engine for checking texts against a reference corpus."""
