"""Structured Streaming over the audit log of events."""
