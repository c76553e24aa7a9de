"""A Spark-native engine for knowledge-graph construction, retrieval and analytics."""
