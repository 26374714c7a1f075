"""Incremental scanning with Structured Streaming."""
