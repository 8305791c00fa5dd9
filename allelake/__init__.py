"""A Spark-native engine for variant-call data: reads, statistics, exports and large-scale table work."""
