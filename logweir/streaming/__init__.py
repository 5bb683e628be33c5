"""Structured Streaming over log lines."""
