"""Spark-native analytics for provenance-aware knowledge graphs."""
