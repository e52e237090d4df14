"""Structured Streaming wrappers around the batch analyses."""
