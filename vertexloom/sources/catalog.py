"""Named graphs, session settings and the log level."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from vertexloom.graph import Graph
from vertexloom.sources.text import clean_name, read_image, write_edge_list, write_image

log = logging.getLogger(__name__)

LOG_LEVELS = {"debug": "DEBUG", "info": "INFO", "warning": "WARN", "error": "ERROR", "fatal": "FATAL"}
#: Settings by what they govern.
PARAMS = {
    "storage": ("spark.sql.files.maxPartitionBytes", "spark.memory.fraction", "spark.memory.storageFraction",
                "spark.sql.warehouse.dir", "spark.checkpoint.dir", "spark.local.dir"),
    "engine": ("spark.master", "spark.executor.cores", "spark.executor.memory", "spark.sql.shuffle.partitions",
               "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
               "spark.sql.autoBroadcastJoinThreshold"),
}


def init_session(app: str = "vertexloom", **conf: str) -> SparkSession:
    """The running session, or a new one with adaptive execution."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def set_conf(spark: SparkSession, path: str | None) -> dict[str, str]:
    """Apply ``key=value`` lines; settings that need a restart are skipped. A missing file changes nothing."""
    done: dict[str, str] = {}
    try:
        lines = [r.value for r in spark.read.text(path).collect()] if path else []
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log.warning("no configuration at %s; defaults stay", path)
        return done
    for line in lines:
        key, eq, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if not eq or key.startswith("#"):
            continue
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
            done[key] = value
        else:
            log.warning("%s cannot be changed while the session runs", key)
    return done


def set_log_level(spark: SparkSession, level: str) -> bool:
    """Set the log level; an unknown one is reported and changes nothing."""
    if level not in LOG_LEVELS:
        log.warning("unknown log level %s", level)
        return False
    spark.sparkContext.setLogLevel(LOG_LEVELS[level])
    return True


def get_params(spark: SparkSession, group: str) -> dict[str, str | None] | None:
    """Settings of ``"storage"`` or ``"engine"``; None for any other group."""
    if group not in PARAMS:
        return None
    fixed = dict(spark.sparkContext.getConf().getAll())
    return {k: fixed.get(k) or spark.conf.get(k, None) for k in PARAMS[group]}


class GraphCatalog:
    """Graphs by name: registered ones first, then images stored under ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/") if root else None
        self._graphs: dict[str, Graph] = {}

    def register(self, graph: Graph, name: str | None = None) -> Graph:
        """Add a graph; one of the same name is replaced."""
        graph.name = clean_name(name or graph.name)
        old = self._graphs.get(graph.name)
        if old is not None and old is not graph and old.in_mem:
            old.unpersist()
        self._graphs[graph.name] = graph
        graph.vertices.createOrReplaceTempView(f"{_view(graph.name)}_vertices")
        graph.edges.createOrReplaceTempView(f"{_view(graph.name)}_edges")
        return graph

    def drop(self, name: str) -> bool:
        graph = self._graphs.pop(clean_name(name), None)
        if graph is None:
            return False
        if graph.in_mem:
            graph.unpersist()
        for part in ("vertices", "edges"):
            self.spark.catalog.dropTempView(f"{_view(graph.name)}_{part}")
        return True

    def _stored(self) -> list[str]:
        if not self.root:
            return []
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        at = jvm.org.apache.hadoop.fs.Path
        return [s.getPath().getName() for s in fs.listStatus(path)
                if fs.exists(at(s.getPath(), "vertices")) and fs.exists(at(s.getPath(), "edges"))]

    def exists(self, name: str) -> bool:
        return clean_name(name) in self._graphs or clean_name(name) in self._stored()

    def get(self, name: str) -> Graph:
        """The graph of that name; raises ``KeyError`` if there is none."""
        name = clean_name(name)
        if name in self._graphs:
            return self._graphs[name]
        if name in self._stored():
            return read_image(self.spark, f"{self.root}/{name}", name)
        raise KeyError(name)

    def list_graphs(self) -> DataFrame:
        """``(name, in_mem)`` by name; a registered graph hides a stored one of its name."""
        rows = {n: False for n in self._stored()} | {n: True for n in self._graphs}
        return self.spark.createDataFrame(sorted(rows.items()), "name string, in_mem boolean").orderBy("name")

    def export(self, name: str, path: str | None = None) -> bool:
        """Store a registered graph as an image; False for graphs that are not registered."""
        graph = self._graphs.get(clean_name(name))
        if graph is None or not (path or self.root):
            log.warning("only registered graphs can be exported, to a path or the catalog's root")
            return False
        return write_image(graph, path or f"{self.root}/{graph.name}")

    def print(self, name: str, path: str, delim: str = "\t", attr: str = "") -> bool:
        """Write a graph as a text edge list."""
        return write_edge_list(self.get(name), path, delim, attr)


def _view(name: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in name)
