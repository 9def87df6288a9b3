"""Whole analyses: ingest, search, dependencies, reports."""
