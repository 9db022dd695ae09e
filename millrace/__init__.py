"""A Spark-native engine for building, indexing, searching and evaluating document collections."""
