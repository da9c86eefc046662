"""Spark-native relational, full-text, vector and spatial analytics."""
