"""A PySpark-native engine for data quality and spend analytics."""
