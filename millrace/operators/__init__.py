"""Operators on DataFrames: search, fusion, ranking stages, catalog, queue, access, evaluation, ingestion."""
