"""Retrieval, lineage, lifecycle and reporting as functions from DataFrames to DataFrames."""
