"""Scans, sinks and embedded constant dimensions."""
