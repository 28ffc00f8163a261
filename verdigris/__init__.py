"""A PySpark-native analytics engine for evaluation data."""
