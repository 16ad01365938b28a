"""A PySpark-native engine for delayed record relay."""
