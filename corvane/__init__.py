"""Corvane: Spark-native evidence curation and corpus preparation."""
