"""PySpark-native order-book and time-series analytics."""
