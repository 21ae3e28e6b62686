"""Spark-native analytics for scientific observations and text corpora."""
