"""Incremental ingestion as a stream of stage files."""
