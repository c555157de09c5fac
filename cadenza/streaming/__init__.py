"""Structured Streaming forms of the event-shaped operators."""
