"""Operators over files, contents and findings: filters, detectors, correlation and scores."""
