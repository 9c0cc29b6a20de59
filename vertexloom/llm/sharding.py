"""Sharding by weighted rendezvous hashing.

Every shard bids for every record with a hash of the record's key and the
shard's number; the highest bid wins. A new shard can only win records for
itself, so adding one moves the least possible. Bids are computed per row, with
no shuffle; positions within a shard follow the key, from narrow rows dealt out
by ranges and counted range by range, so no task ever holds a whole shard.

Defined cases: a null text has size 1 and the checksum of the empty string; a
null key hashes like the key ``"null"`` and goes to one shard, before all other
keys; repeated rows get slots of their own, next to each other; texts are
measured whole, whatever their length; bids that tie go to the smaller shard; an
empty table gives an empty result; other columns are ignored. The law ``key``
decides by key alone, so equal texts under different keys may lie in different
shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vertexloom.plans.scratch import Scratch

#: Hexadecimal digits of a bid's MD5 that count: 52 bits, which a double holds exactly.
DIGITS = 13


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard that bids most for ``key``; shard ``i`` has weight ``weights[i]``, a zero weight never wins.

    A bid is ``-weight / ln(u)`` with ``u`` uniform in (0, 1), from the MD5 of
    shard and key; ties go to the smaller shard.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a weight above zero")
    if min(weights) < 0:
        raise ValueError("weights must not be negative")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    even = len({w for w in weights if w}) == 1
    bids = []
    for i, w in enumerate(weights):
        if w:
            drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{i}:"), text).cast("binary")), 1, DIGITS), 16, 10)
            u = drawn.cast("long")
            # under equal weights the highest draw has the highest bid
            bid = u if even else F.lit(-float(w)) / F.log((u.cast("double") + 0.5) / float(1 << 4 * DIGITS))
            bids.append(F.struct(bid.alias("bid"), F.lit(-i).alias("i")))
    return (-(F.array_max(F.array(*bids))["i"])).cast("int")


def shard(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None,
          text_col: str = "text") -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` for every row.

    ``slot`` counts from zero without gaps within each shard, in the order of
    key, size and checksum. ``grown_shard`` is the shard under the weights
    ``grown``, null without them.
    """
    scratch = Scratch(df.sparkSession, "shards")
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    placed = scratch.save(df.select(
        F.col(key).alias("k"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        (rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row")), "placed")
    order = ["shard", "k", "size", "text_crc32", "row"]
    dealt = scratch.save(placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), (F.sum("n").over(
        Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order[1:])) - 1
    return dealt.withColumn("place", place).join(
        before, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))).select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("place")).cast("long").alias("slot"), "grown_shard")
