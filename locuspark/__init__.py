"""PySpark-native analytics for position-indexed, multi-sample measurement data."""
