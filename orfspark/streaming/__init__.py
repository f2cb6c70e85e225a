"""Incremental versions on Structured Streaming."""
