"""A Spark-native engine for indexing and searching source and text corpora."""
