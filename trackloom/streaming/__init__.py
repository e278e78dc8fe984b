"""Structured Streaming over journals and events."""
