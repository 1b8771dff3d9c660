"""A Spark-native fact lake: extraction, storage and structural queries as DataFrames."""
