"""Scans of arriving objects."""
