"""Spark-native HTTP threat analytics."""
