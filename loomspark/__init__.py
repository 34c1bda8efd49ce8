"""Spark-native engine for retrieval-augmented document processing."""
