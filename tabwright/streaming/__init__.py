"""Structured Streaming variants of the file readers."""
