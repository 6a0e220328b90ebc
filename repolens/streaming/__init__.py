"""Incremental ingestion with Structured Streaming (an extension)."""
