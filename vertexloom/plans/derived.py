"""Graphs derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vertexloom.graph import Graph
from vertexloom.plans.scratch import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def returned_in_turn(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: from each returned part to the next one of the same order."""
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    e = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), nxt.alias("dst"))
    e = e.where("dst is not null and dst <> src").distinct()
    return Graph.from_edges(Scratch(spark, "derived").save(e, "turn"), name="returned_in_turn")


def returned_together(spark: SparkSession, sf_dir: str, all_parts: bool = False, bulk: bool = False) -> Graph:
    """Undirected: parts returned in one order; ``all_parts`` adds every other part as an isolate.

    ``bulk`` counts only returns in quantities over 40, which falls into many small components.
    """
    li = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    li = (li.where("l_quantity > 40") if bulk else li).select("l_orderkey", "l_partkey")
    a, b = li.withColumnRenamed("l_partkey", "src"), li.withColumnRenamed("l_partkey", "dst")
    e = a.join(b, "l_orderkey").where("src < dst").select("src", "dst").distinct()
    e = Scratch(spark, "derived").save(e, "together")
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")) if all_parts else None
    return Graph.from_edges(e, directed=False, vertices=parts, name="returned_together")


def traded(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    """Weighted: order lines from each supplier's nation to each other customer's nation; undirected, both ways together."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    buyer = _read(spark, sf_dir, "orders").join(
        _read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    seller = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    e = line.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    e = e.select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).where("src <> dst")
    if not directed:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    e = e.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return Graph.from_edges(Scratch(spark, "derived").save(e, "traded"), weight="weight", directed=directed, name="traded")
