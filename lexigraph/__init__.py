"""Spark-native engine for entity-centric knowledge graphs built from text."""
