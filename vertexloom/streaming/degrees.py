"""Degrees over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_degree(edges: DataFrame, time_col: str = "ts", window: str = "10 minutes",
                    late: str = "10 minutes") -> DataFrame:
    """``(window, id, degree)`` of a streaming edge frame ``(src, dst, time_col)``; rows later than ``late`` are dropped."""
    ends = edges.withWatermark(time_col, late).select(time_col, F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy(F.window(time_col, window), "id").agg(F.count("*").alias("degree"))
