"""Readers and writers of signature files, objects and containers."""
