"""Structured Streaming: ingest of the event log."""
