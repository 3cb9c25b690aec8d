"""A PySpark-native analytics engine for key-value operation logs."""
