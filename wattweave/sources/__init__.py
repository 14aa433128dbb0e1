"""Scans, sinks and table shapes."""
