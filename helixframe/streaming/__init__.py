"""Structured Streaming extension over events."""
