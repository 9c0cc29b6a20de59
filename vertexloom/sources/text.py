"""Edge lists as text, adjacency text, and graph images as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vertexloom.graph import Graph

#: Names of attribute types, and the Spark type each stands for.
ATTR_TYPES = {"": None, "I": "int", "int": "int", "L": "long", "long": "long", "F": "float", "float": "float",
              "D": "double", "double": "double"}


def clean_name(name: str) -> str:
    """A graph's registered name: slashes and spaces become underscores."""
    return name.replace("/", "_").replace(" ", "_")


def attr_type(name: str) -> str | None:
    if name not in ATTR_TYPES:
        raise ValueError(f"attr_type must be one of {sorted(ATTR_TYPES)}")
    return ATTR_TYPES[name]


def _delimiter(spark: SparkSession, lines: DataFrame) -> str:
    first = lines.limit(1).collect()
    line = first[0].value.strip() if first else ""
    return "\t" if "\t" in line else "," if "," in line else " "


def read_edge_list(spark: SparkSession, path: str | list[str], *, directed: bool = True, delim: str = "auto",
                   attr: str = "", name: str | None = None, dense: bool = True) -> Graph:
    """A graph from delimited text ``src dst [attribute]``.

    Lines that are blank or start with ``#`` are skipped. ``delim="auto"`` looks
    at the first other line; a blank delimiter means any run of white space.
    Vertices run from zero to the largest id, gaps being isolated
    (``dense=False`` keeps only ids that occur). A missing path raises.
    """
    kind = attr_type(attr)
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    sep = _delimiter(spark, lines) if delim == "auto" else delim
    pattern = r"\s+" if sep == " " else r"\s*" + "".join("\\" + c if not c.isalnum() and c != "\t" else c for c in sep) + r"\s*"
    parts = F.split(F.trim("value"), pattern)
    cols = [parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst")]
    if kind:
        cols.append(F.get(parts, F.lit(2)).cast(kind).alias("weight"))
    given = path if isinstance(path, str) else path[0]
    return Graph.from_edges(lines.select(*cols), weight="weight" if kind else None, directed=directed, dense=dense,
                            name=clean_name(name or given.rstrip("/").rsplit("/", 1)[-1]))


def read_adjacency(spark: SparkSession, path: str, *, directed: bool = True, name: str = "graph") -> Graph:
    """A graph from lines ``src dst dst ...``; a line with one id is an isolated vertex."""
    ids = F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda x: x.cast("long"))
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(ids.alias("a"))
    edges = rows.select(F.col("a")[0].alias("src"), F.explode(F.slice("a", 2, 1 << 30)).alias("dst"))
    vertices = rows.select(F.explode("a").alias("id"))
    return Graph.from_edges(edges, directed=directed, vertices=vertices, name=clean_name(name))


def write_edge_list(graph: Graph, path: str, delim: str = "\t", attr: str = "") -> bool:
    """Write ``src dst [weight]`` as text files under ``path``, in parallel; False if it exists already."""
    cols = [F.col("src").cast("string"), F.col("dst").cast("string")]
    if attr:
        if "weight" not in graph.edges.columns:
            raise ValueError("the graph has no edge attribute")
        cols.append(F.col("weight").cast(attr_type(attr)).cast("string"))
    try:
        graph.edges.select(F.concat_ws(delim, *cols).alias("value")).write.text(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            return False
        raise
    return True


def write_image(graph: Graph, path: str, buckets: int | None = None) -> bool:
    """Write the graph as Parquet: ``path/vertices``, ``path/edges`` sorted by source, and its direction."""
    edges = graph.edges.repartition(buckets, "src") if buckets else graph.edges
    edges.sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.spark.createDataFrame([(graph.directed, graph.name)], "directed boolean, name string").coalesce(1).write.mode(
        "overwrite").json(f"{path}/meta")
    return True


def read_image(spark: SparkSession, path: str, name: str | None = None) -> Graph:
    """The graph that ``write_image`` wrote."""
    meta = spark.read.schema("directed boolean, name string").json(f"{path}/meta").first()
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), meta.directed,
                 name or meta.name)
