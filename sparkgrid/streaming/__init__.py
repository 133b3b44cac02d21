"""Structured Streaming roll-ups."""
