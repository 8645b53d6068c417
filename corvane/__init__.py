"""A Spark-native engine for document retrieval, its evaluation and its analytics."""
