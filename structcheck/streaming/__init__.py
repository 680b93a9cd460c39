"""Streaming views of progress events."""
