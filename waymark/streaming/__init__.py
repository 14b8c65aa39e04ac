"""Structured Streaming jobs over the tool log."""
