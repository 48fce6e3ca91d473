"""A Spark-native engine for data movement, chunked arrays and run telemetry."""
