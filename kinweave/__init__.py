"""A Spark-native engine that groups similar records into families."""
