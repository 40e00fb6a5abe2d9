"""Structured Streaming ingest of documents (an extension: the batch operators do not need it)."""
