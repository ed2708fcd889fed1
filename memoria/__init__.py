"""Spark-native working-memory analytics: records, retrieval, lineage, lifecycle, ingest and reports as DataFrames."""
