"""parley: Spark-native analytics over two-party conversation logs."""
