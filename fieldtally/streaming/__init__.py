"""Structured Streaming jobs for rollups and facts."""
