"""postforge: a PySpark-native engine for opportunity postings and text corpora."""
