"""Structured Streaming: token rows from a source to the log, and from the log to sealed series."""
