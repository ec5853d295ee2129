"""Structured Streaming jobs (ST1, ST2)."""
