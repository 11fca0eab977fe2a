"""Structured Streaming jobs with keyed state."""
