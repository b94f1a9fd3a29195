"""Tidewell: a PySpark-native analytics engine for multi-sensor recordings."""
