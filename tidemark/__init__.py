"""Spark-native analytics for insurance-risk submissions."""
