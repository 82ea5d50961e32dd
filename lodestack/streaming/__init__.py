"""Streaming forms of the capture log."""
