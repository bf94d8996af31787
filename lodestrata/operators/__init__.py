"""Operators beyond filter, projection and order: pivots, full-text search, eviction, correlation, metadata."""
