"""Structured Streaming operators (keyed state)."""
