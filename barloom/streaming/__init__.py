"""Incremental bars and indicators with Structured Streaming."""
