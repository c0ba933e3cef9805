"""A Spark-native engine for document knowledge bases and training-data pipelines."""
