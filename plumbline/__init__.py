"""A Spark-native engine for evidence and claim checking over large text collections."""
