"""Spark-native analytics over file and document corpora."""
