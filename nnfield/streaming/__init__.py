"""Structured Streaming jobs over video frames."""
