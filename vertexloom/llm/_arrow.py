"""Arrow-batch helpers shared by the operators.

Batches come as Spark makes them, bounded in rows and bytes by the session's own
settings; kernels cut them further by themselves, so no call changes a setting
that another operator's lazy plan would see.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows and bytes that a kernel gets at a time; a single larger row comes alone.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    On a cluster whose executors lack that folder, ship the package with
    ``--py-files`` as usual.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in parts and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, parts)])


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS,
           size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and about ``size`` bytes; empty ones are left out."""
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            n = b.num_rows
            if n > 1 and (n > rows or b.nbytes > size):
                cut = min(rows, n // 2) if b.nbytes > size else rows
                todo += [b.slice(cut), b.slice(0, cut)]
            elif n:
                yield b


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: StructType | str) -> DataFrame:
    """Apply ``kernel`` to each slice of the Arrow batches, one in memory at a time."""
    find_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = kernel(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Each wanted column name, lengthened until no other column has it, case ignored."""
    used = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
