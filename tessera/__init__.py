"""A PySpark-native analytics library: DataFrame operators over parquet tables."""
