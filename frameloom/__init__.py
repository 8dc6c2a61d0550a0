"""Spark-native analytics over per-frame observations of videos."""
