"""Structured Streaming jobs that keep features and lists current."""
