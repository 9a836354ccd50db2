"""Schemas, scans, sinks and the domain views."""
