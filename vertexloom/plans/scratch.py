"""Written tables that cut lineage.

Every table goes to the shared folder named in ``spark.checkpoint.dir``, so a
lost executor never takes the only copy of a result with it. A folder of our
own is made only where that setting is empty, and only in local mode, where the
driver and the executors are one process. What is left of the tables when the
process ends is deleted then.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, tuple] = {}  # folder: what can delete it when the session may have stopped


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="vertexloom-")
    return _own[app]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one run, under one folder of the shared directory."""

    def __init__(self, spark: SparkSession, label: str = "run"):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        _made[self.root] = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:04d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return a frame that only reads the written files."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._vertexloom_path = path
        return out

    def union(self, frames: list[DataFrame]) -> DataFrame:
        """The rows of several saved frames of one schema, as a single scan."""
        paths = [f._vertexloom_path for f in frames]
        return self.spark.read.schema(frames[0].schema).parquet(*paths)

    def drop(self, df: DataFrame | None) -> None:
        """Delete what ``save`` returned; nothing may read it afterwards."""
        path = getattr(df, "_vertexloom_path", None)
        if path:
            delete(self.spark, path)


def purge(spark: SparkSession) -> None:
    """Delete every scratch folder this process made; results that still read them are lost."""
    while _made:
        delete(spark, _made.popitem()[0])


@atexit.register
def _at_exit() -> None:
    for root, (jvm, conf) in _made.items():
        try:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM has gone, and whoever stopped it has the folder
            return
