"""Watching for saved files with Structured Streaming."""
