"""Structured Streaming versions of the batch roll-ups."""
