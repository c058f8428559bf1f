"""strataloom: a Spark-native engine for curating large collections of nested scene records."""
