"""A PySpark-native library for record linkage and match analytics."""
