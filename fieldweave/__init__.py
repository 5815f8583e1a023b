"""fieldweave: a PySpark-native engine for research-metadata analytics."""
