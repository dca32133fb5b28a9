"""Incremental ingestion of reads."""
