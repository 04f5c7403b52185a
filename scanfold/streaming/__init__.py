"""Streaming scans and state."""
