"""Whole scans, registered queries and table versions."""
