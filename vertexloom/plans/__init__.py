"""Iteration, lineage cutting and derived-graph plans."""
