"""Structured Streaming forms of what the batch operators do over event time."""
