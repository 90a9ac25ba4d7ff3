"""Scans, sinks and the views that shape the driver's tables into the library's records."""
