"""A PySpark-native analytics engine for lake tables."""
