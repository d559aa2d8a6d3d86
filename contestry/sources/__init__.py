"""Readers and writers: CSV, parquet, nested JSON and HTML pages."""
