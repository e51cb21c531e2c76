"""Spark-native engine for multilingual parallel-corpus preparation and evaluation."""
