"""Scans, payload shaping, sinks and staging."""
