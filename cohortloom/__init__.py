"""A Spark-native engine for feature x sample count matrices."""
