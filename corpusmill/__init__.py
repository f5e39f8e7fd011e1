"""Spark-native curation and evaluation operators for multimodal corpora."""
