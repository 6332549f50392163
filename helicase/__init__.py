"""A PySpark-native engine for comparative-genomics screens."""
