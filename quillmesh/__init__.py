"""A PySpark-native engine for spatial tagging, retrieval and document analytics."""
