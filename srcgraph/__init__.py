"""A PySpark-native engine for analytics over source-code and document corpora."""
