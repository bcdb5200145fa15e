"""A Spark-native engine for time-stamped sensor and event data."""
