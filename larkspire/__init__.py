"""Spark-native engine for document collections: retrieval, incremental snapshots, ranking metrics and catalog queries."""
