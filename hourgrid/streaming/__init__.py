"""Structured Streaming twins of the live-sensor steps."""
