"""Incremental catch-up with Structured Streaming."""
