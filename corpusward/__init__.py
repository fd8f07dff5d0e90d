"""Scans source repositories and prepares training data, as Spark jobs."""

__version__ = "0.2.0"
