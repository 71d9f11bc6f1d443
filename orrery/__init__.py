"""A PySpark-native engine for ordered, scored event collections."""
