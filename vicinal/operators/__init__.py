"""Operators: index construction, searches, metrics and diagnostics."""
