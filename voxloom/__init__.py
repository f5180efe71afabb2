"""Spark-native analytics for speech corpora and text corpora."""
