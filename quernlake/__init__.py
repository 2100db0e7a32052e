"""A Spark-native engine for payment analytics, documentation corpora, retrieval and training data."""
