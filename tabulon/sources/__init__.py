"""Scans, reference dimensions and sinks."""
