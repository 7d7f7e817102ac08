"""Spark-native analytics for ranked, timed and segmented result tables."""
