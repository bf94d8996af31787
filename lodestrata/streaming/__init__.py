"""Continuous ingest into collections."""
