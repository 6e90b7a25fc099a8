"""Incremental sync and Structured Streaming jobs."""
