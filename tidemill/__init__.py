"""A Spark-native engine for transaction events and large text corpora."""
