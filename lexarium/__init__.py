"""A PySpark-native analytics engine for text corpora."""
