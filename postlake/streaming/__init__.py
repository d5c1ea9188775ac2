"""Incremental ingestion and windowed counts."""
