"""PySpark-native analytics for transaction lines."""
