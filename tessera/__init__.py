"""A PySpark-native analytics engine for records of many shapes, clustered by key."""
