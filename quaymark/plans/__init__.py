"""Whole runs: from files and contents to findings, scores and reports; and the registered queries."""
