"""corpuslens: a PySpark-native engine for auditing text corpora."""
