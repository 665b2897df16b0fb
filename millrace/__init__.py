"""millrace: a PySpark-native analytics engine for evaluation-data work."""
