"""Whole-graph operators."""
