"""Readers and writers for logs, reports, sessions and metric tables."""
