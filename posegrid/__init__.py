"""A PySpark-native analytics engine for time-stamped multi-sensor data."""
