"""Streams: feedback events in windows, incremental ingest with merged statistics."""
