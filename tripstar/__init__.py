"""tripstar: PySpark-native trip analytics."""
