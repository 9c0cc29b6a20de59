"""Incremental measures over streams of edges."""
