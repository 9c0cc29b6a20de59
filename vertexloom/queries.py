"""Registered graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vertexloom.graph import Graph
from vertexloom.functions.linalg import multiply, sparse_matrix, spectral_embedding
from vertexloom.operators.components import clusters, largest_component
from vertexloom.operators.degree import degree
from vertexloom.operators.kcore import kcore
from vertexloom.operators.kmeans import kmeans, kmeans_graph
from vertexloom.operators.neighbours import betweenness, diameter, overlap
from vertexloom.operators.pagerank import pagerank
from vertexloom.operators.subgraph import induced
from vertexloom.operators.triangles import local_scan, topk_scan, transitivity, triangles
from vertexloom.plans.derived import returned_in_turn, returned_together, traded
from vertexloom.plans.scratch import Scratch
from vertexloom.sources.catalog import GraphCatalog, get_params, init_session, set_conf, set_log_level
from vertexloom.sources.text import read_adjacency, read_edge_list, write_edge_list, write_image

_TURN = """e as (select distinct l_partkey s, np d from (
    select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) np
    from lineitem where l_returnflag = 'R') where np is not null and np <> l_partkey),
  v as (select s id from e union select d from e)"""
_TOGETHER = """e as (select distinct a.l_partkey s, b.l_partkey d from lineitem a join lineitem b
    on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey
    where a.l_returnflag = 'R' and b.l_returnflag = 'R'),
  v as (select s id from e union select d from e)"""
_BULK = _TOGETHER.replace("b.l_returnflag = 'R')", "b.l_returnflag = 'R' and a.l_quantity > 40 and b.l_quantity > 40)")
_LINKS = ", n as (select distinct s, d from (select s, d from e union all select d, s from e) where s <> d)"
_REACH = """, r as (select id, id m from v union select n.d, r.m from r join n on r.id = n.s where r.m < n.d),
  c as (select id, min(m) component from r group by id)"""
_TRADED = """e as (select s_nationkey::bigint s, c_nationkey::bigint d, count(*)::double w from lineitem
    join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
    where s_nationkey <> c_nationkey group by 1, 2),
  v as (select s id from e union select d from e)"""
_DEGREE = ", g as (select id, count(*) k from (select s id from e union all select d from e) group by id)"
_TRI = """, t as (select x.s a, x.d b, y.d c from e x join e y on x.d = y.s join e z on z.s = x.s and z.d = y.d),
  p as (select id, count(*) k from (select a id from t union all select b from t union all select c from t) group by id)"""
_BALL = """, ball as (select id, id w from v union select s, d from n),
  sc as (select b.id, count(*) scan from ball b join e on e.s = b.w join ball o on o.id = b.id and o.w = e.d group by b.id)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def _round(df: DataFrame, *cols: str) -> DataFrame:
    """Six digits, so that the order of sums does not show; NaN becomes null."""
    for c in cols:
        df = df.withColumn(c, F.when(~F.isnan(c), F.round(c, 6)))
    return df


for _mode, _ends in (("both", "select s id from e union all select d from e"), ("in", "select d id from e"),
                     ("out", "select s id from e")):
    _query(f"""with {_TURN} select v.id, cast(count(x.id) as bigint) degree from v left join ({_ends}) x on v.id = x.id
        group by v.id""", f"degree_{_mode}")(
        lambda spark, sf_dir, mode=_mode: degree(returned_in_turn(spark, sf_dir), mode))


@_query(f"with {_TURN} select (select count(*) from v) vcount, (select count(*) from e) ecount, true directed")
def vcount_ecount(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = returned_in_turn(spark, sf_dir)
    return spark.createDataFrame([(g.vcount, g.ecount, g.directed)], "vcount long, ecount long, directed boolean")


@_query(f"""with {_TURN} select 'Graph returned_in_turn (D): ' || (select count(*) from v) || ' ' || (select count(*) from e)
  as shown, 'returned_in_turn' as name, true as directed, false as in_mem""")
def graph_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a graph says of itself."""
    g = returned_in_turn(spark, sf_dir)
    return spark.createDataFrame([(repr(g), g.name, g.directed, g.in_mem)],
                                 "shown string, name string, directed boolean, in_mem boolean")


@_query("""select * from (values (1, 'unknown', false, 0), (2, 'registered', true, 1), (3, 'exported', true, 1),
  (4, 'dropped', true, 1), (5, 'dropped again', true, 1), (6, 'never stored', false, 1)) t(step, state, found, listed)""")
def catalog_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph is registered, stored and dropped; afterwards only its image is found."""
    c = GraphCatalog(spark, Scratch(spark, "catalog").path("graphs"))
    name, rows = "returned_together", []

    def note(state: str, what: str = name) -> None:
        rows.append((len(rows) + 1, state, c.exists(what), c.list_graphs().count()))

    note("unknown")
    c.register(returned_together(spark, sf_dir))
    note("registered")
    c.export(name)
    note("exported")
    c.drop(name)
    note("dropped")
    c.drop(name)
    note("dropped again")
    note("never stored", "another")
    return spark.createDataFrame(rows, "step int, state string, found boolean, listed int")


@_query("""select * from (values ('engine settings', true), ('storage settings', true), ('other settings', false),
  ('running session', true), ('configuration read', true), ('missing configuration', false), ('known level', true),
  ('unknown level', false)) t(what, done)""")
def session_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by group, the running session, a configuration file and log levels."""
    path = Scratch(spark, "conf").path("settings")
    now = spark.conf.get("spark.sql.shuffle.partitions")
    spark.createDataFrame([(f"spark.sql.shuffle.partitions={now}",)], "value string").coalesce(1).write.text(path)
    rows = [("engine settings", bool(get_params(spark, "engine"))), ("storage settings", bool(get_params(spark, "storage"))),
            ("other settings", get_params(spark, "none") is not None), ("running session", init_session() is not None),
            ("configuration read", set_conf(spark, path) == {"spark.sql.shuffle.partitions": now}),
            ("missing configuration", bool(set_conf(spark, path + "-none"))), ("known level", set_log_level(spark, "error")),
            ("unknown level", set_log_level(spark, "loud"))]
    return spark.createDataFrame(rows, "what string, done boolean")


@_query(f"with {_TURN} select s src, d dst from e")
def edge_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as text and read again."""
    path = Scratch(spark, "text").path("edges")
    write_edge_list(returned_in_turn(spark, sf_dir), path)
    return read_edge_list(spark, path).edges


@_query(f"with {_TURN} select s src, d dst from e")
def image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported from a catalog and found there by another one."""
    root = Scratch(spark, "catalog").path("graphs")
    first = GraphCatalog(spark, root)
    first.register(returned_in_turn(spark, sf_dir))
    first.export("returned_in_turn")
    return GraphCatalog(spark, root).get("returned_in_turn").edges


@_query(f"with {_TURN} select s src, d dst from e")
def adjacency_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as adjacency lines and read again."""
    path = Scratch(spark, "adjacency").path("lists")
    g = returned_in_turn(spark, sf_dir)
    g.edges.groupBy("src").agg(F.collect_list("dst").alias("a")).select(
        F.concat_ws(" ", F.col("src").cast("string"), F.transform("a", lambda x: x.cast("string"))).alias("value")
    ).write.text(path)
    return read_adjacency(spark, path).edges


@_query("select 'returned_in_turn' as name, true as in_mem union all select 'returned_together', false")
def list_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "catalog").path("graphs")
    write_image(returned_together(spark, sf_dir), f"{root}/returned_together")
    catalog = GraphCatalog(spark, root)
    catalog.register(returned_in_turn(spark, sf_dir))
    return catalog.list_graphs()


@_query(f"with {_TURN} select s i, d j, cast(1 as double) v from e", "sparse_matrix")
def sparse_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_matrix(returned_in_turn(spark, sf_dir))


for _t, _row, _col in ((False, "s", "d"), (True, "d", "s")):
    _query(f"""with {_TURN} select v.id, coalesce(x.value, 0.0::double) as value from v left join
        (select {_row} id, sum(cast({_col} as double)) as value from e group by 1) x on v.id = x.id""",
           "spmv_t" if _t else "spmv")(
        lambda spark, sf_dir, t=_t: (lambda g: multiply(g, g.vertices.select("id", F.col("id").cast("double").alias("value")), t))(
            returned_in_turn(spark, sf_dir)))


@_query(f"""with recursive {_TURN}, o as (select s, 1.0::double / count(*) w from e group by s),
  step as (select e.s, e.d, o.w from e join o on e.s = o.s union all select id, id, 0.0::double from v),
  pr as (select id, 0 as k, (1 - 0.85::double) as p from v union all
    select step.d, pr.k + 1, (1 - 0.85::double) + 0.85::double * sum(pr.p * step.w)
    from pr join step on pr.id = step.s where pr.k < 10 group by step.d, pr.k)
  select id, round(p, 6) as rank from pr where k = 10""")
def pagerank_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(pagerank(returned_in_turn(spark, sf_dir), max_iters=10, tol=0), "rank")


@_query(f"""with {_TRADED} select v.id, coalesce(x.value, 0.0::double) as value from v left join
  (select d id, sum(w * (s + 1)) as value from e group by 1) x on v.id = x.id""")
def spmv_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transposed matrix of order lines between nations times the nations' numbers."""
    g = traded(spark, sf_dir)
    return multiply(g, g.vertices.select("id", (F.col("id") + 1).cast("double").alias("value")), True)


@_query(f"""with recursive {_TURN}, o as (select s, 1.0::double / count(*) w from e group by s),
  step as (select e.s, e.d, o.w from e join o on e.s = o.s union all select id, id, 0.0::double from v),
  pr as (select id, 0 as k, (1 - 0.85::double) as p from v union all
    select step.d, pr.k + 1, (1 - 0.85::double) + 0.85::double * sum(pr.p * step.w)
    from pr join step on pr.id = step.s where pr.k < 80 group by step.d, pr.k),
  still as (select min(a.k) as k from (select b.k, max(abs(b.p - a.p)) as x from pr a join pr b on a.id = b.id and b.k = a.k + 1
    group by b.k) a where x <= 1e-3 * (1 - 0.85::double))
  select id, round(p, 6) as rank from pr where k = (select k from still)""", "pagerank")
def pagerank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until no rank moves by more than a thousandth of its start."""
    return _round(pagerank(returned_in_turn(spark, sf_dir)), "rank")


@_query(f"with recursive {_TURN}{_LINKS}{_REACH} select id, component from c")
def wcc_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(returned_in_turn(spark, sf_dir))


@_query(f"with recursive {_TOGETHER}{_LINKS}{_REACH} select id, component from c")
def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(returned_together(spark, sf_dir))


@_query(f"with recursive {_BULK}{_LINKS}{_REACH} select id, component from c")
def wcc_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(returned_together(spark, sf_dir, bulk=True))


@_query(f"""with recursive {_BULK}{_LINKS}{_REACH}
  select p_partkey as id, coalesce(component, 4294967295) as component from part left join c on p_partkey = id""")
def wcc_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(returned_together(spark, sf_dir, all_parts=True, bulk=True))


@_query(f"""with {_TOGETHER}{_DEGREE} select p_partkey as id, cast(coalesce(k, 0) as bigint) as degree
  from part left join g on p_partkey = id""")
def degree_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degree(returned_together(spark, sf_dir, all_parts=True))


@_query(f"""with recursive {_TURN}, f as (select id as a, id as b from v union select f.a, e.d from f join e on f.b = e.s)
  select x.a as id, min(x.b) as component from f x join f y on x.a = y.b and x.b = y.a group by x.a""")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(returned_in_turn(spark, sf_dir), "strong")


def _largest_sql(graph: str) -> str:
    return f"""with recursive {graph}{_LINKS}{_REACH},
      big as (select component from c group by component order by count(*) desc, component limit 1),
      m as (select id, row_number() over (order by id) - 1 as k from c where component = (select component from big))
      select a.k as src, b.k as dst from e join m a on e.s = a.id join m b on e.d = b.id"""


@_query(_largest_sql(_TOGETHER))
def lcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_component(returned_together(spark, sf_dir)).edges


@_query(_largest_sql(_BULK))
def lcc_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_component(returned_together(spark, sf_dir, bulk=True)).edges


@_query(f"""with {_TURN}{_DEGREE}, keep as (select id from g where k >= 10)
  select s as src, d as dst from e where s in (select id from keep) and d in (select id from keep)""")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph between parts with ten or more edges."""
    g = returned_in_turn(spark, sf_dir)
    return induced(g, degree(g).where("degree >= 10"), compress=False).edges


@_query(f"with {_TOGETHER}{_TRI} select v.id, cast(coalesce(k, 0) as bigint) as triangles from v left join p on v.id = p.id")
def triangles_und(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles(returned_together(spark, sf_dir))


@_query(f"""with {_TURN}, t as (select x.s as a, x.d as b, y.d as c from e x join e y on x.d = y.s join e z on z.s = y.d and z.d = x.s)
  select v.id, count(t.a) as triangles from v left join t on v.id = t.a group by v.id""")
def triangles_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles(returned_in_turn(spark, sf_dir), "cycle")


@_query(f"""with {_TURN}{_LINKS}, t as (select x.s as a from n x join n y on x.d = y.s join n z on z.s = y.d and z.d = x.s)
  select v.id, cast(count(t.a) // 2 as bigint) as triangles from v left join t on v.id = t.a group by v.id""")
def triangles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles(returned_in_turn(spark, sf_dir), "all")


@_query(f"with {_TURN}{_DEGREE} select id, cast(k as bigint) as scan from g")
def scan0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_scan(returned_in_turn(spark, sf_dir), 0)


@_query(f"with {_TURN}{_LINKS}{_BALL} select id, scan from sc")
def scan1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_scan(returned_in_turn(spark, sf_dir), 1)


@_query(f"with {_TOGETHER}{_LINKS}{_BALL} select id, scan from sc")
def scan1_und(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_scan(returned_together(spark, sf_dir), 1)


@_query(f"""with {_TURN}{_LINKS}, one as (select id, id as w from v union select s, d from n),
  ball as (select id, w from one union select one.id, n.d from one join n on one.w = n.s)
  select b.id, count(*) as scan from ball b join e on e.s = b.w join ball o on o.id = b.id and o.w = e.d group by b.id""")
def scan2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_scan(returned_in_turn(spark, sf_dir), 2)


@_query(f"with {_TURN}{_LINKS}{_BALL} select id as vid, scan from sc order by scan desc, id limit 10")
def topk_scan_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_scan(returned_in_turn(spark, sf_dir), 1, 10)


@_query(f"""with {_TOGETHER}{_TRI}{_DEGREE} select g.id, case when g.k >= 2 then
  round(2.0::double * coalesce(p.k, 0) / (g.k * (g.k - 1)), 6) end as transitivity from g left join p on g.id = p.id""")
def transitivity_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(transitivity(returned_together(spark, sf_dir), "local"), "transitivity")


@_query(f"""with {_TURN}{_LINKS}{_BALL}{_DEGREE} select g.id, case when g.k >= 2 then
  round((scan - g.k)::double / (g.k * (g.k - 1)), 6) end as transitivity from g join sc on g.id = sc.id""")
def transitivity_local_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(transitivity(returned_in_turn(spark, sf_dir), "local"), "transitivity")


@_query(f"""with {_TOGETHER}{_TRI}{_DEGREE} select round(2.0::double * (select sum(k) from p)
  / (select sum(k * (k - 1)) from g), 6) as transitivity""")
def transitivity_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(transitivity(returned_together(spark, sf_dir)), "transitivity")


@_query(f"""with {_TURN}{_LINKS}{_BALL}{_DEGREE} select round(sum(scan - g.k)::double / sum(g.k * (g.k - 1)), 6)
  as transitivity from g join sc on g.id = sc.id""")
def transitivity_global_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(transitivity(returned_in_turn(spark, sf_dir)), "transitivity")


def _core_sql(graph: str, rounds: int) -> str:
    """H-indices of the neighbours' values, from the degrees on, until they have long settled."""
    sql = f"""with {graph}, m as (select s a, d b from e where s <> d union all select d, s from e where s <> d),
      h0 as materialized (select a as id, count(*) as c from m group by a)"""
    for i in range(rounds):
        sql += f""", h{i + 1} as materialized (select id, max(least(c, r)) as c from (select m.a as id, h.c,
          row_number() over (partition by m.a order by h.c desc) as r from m join h{i} h on m.b = h.id) group by id)"""
    return sql + f", core as (select v.id, coalesce(c, 0) as c from v left join h{rounds} h on v.id = h.id)"


@_query(_core_sql(_TOGETHER, 40) + " select id, cast(c as bigint) as core from core")
def kcore_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kcore(returned_together(spark, sf_dir), 1, 0)


@_query(_core_sql(_TURN, 40) + " select id, cast(case when c < 2 then 1 when c > 10 then -1 else c end as bigint) as core from core")
def kcore_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kcore(returned_in_turn(spark, sf_dir), 2, 10)


@_query(_core_sql(_TURN, 40) + " select id, cast(c as bigint) as core from core")
def kcore_directed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kcore(returned_in_turn(spark, sf_dir), 1, 0)


@_query(f"""with {_TURN}{_LINKS}, dg as (select s, count(*) k from n group by s),
  m as (select a.s as i, b.s as j, count(*) as common from n a join n b on a.d = b.d group by 1, 2)
  select i as vid_i, j as vid_j, common, round(common::double / (x.k + y.k - common), 6) as overlap
  from m join dg x on m.i = x.s join dg y on m.j = y.s""", "overlap")
def overlap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between all vertices."""
    g = returned_in_turn(spark, sf_dir)
    return _round(overlap(g, g.vertices), "overlap")


_BFS = """, root as (select id from g order by k desc, id limit 1),
  b1 as (select id, 0 as dist from root union select n.d, b1.dist + 1 from b1 join n on b1.id = n.s where b1.dist < 40),
  far as (select id from (select id, min(dist) as x from b1 group by id) order by x desc, id limit 1),
  b2 as (select id, 0 as dist from far union select n.d, b2.dist + 1 from b2 join n on b2.id = n.s where b2.dist < 40)"""


@_query(f"""with recursive {_TOGETHER}{_LINKS}{_DEGREE}{_BFS}
  select cast(max(x) as bigint) as diameter from (select min(dist) as x from b1 group by id
    union all select min(dist) from b2 group by id)""", "diameter")
def diameter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diameter(returned_together(spark, sf_dir))


@_query(f"""with recursive {_TURN}{_DEGREE}, root as (select id from g order by k desc, id limit 1),
  b1 as (select id, 0 as dist from root union select e.d, b1.dist + 1 from b1 join e on b1.id = e.s where b1.dist < 40),
  far as (select id from (select id, min(dist) as x from b1 group by id) order by x desc, id limit 1),
  b2 as (select id, 0 as dist from far union select e.s, b2.dist + 1 from b2 join e on b2.id = e.d where b2.dist < 40)
  select cast(max(x) as bigint) as diameter from (select min(dist) as x from b1 group by id
    union all select min(dist) from b2 group by id)""")
def diameter_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along the edges, and back against them from the farthest vertex."""
    return diameter(returned_in_turn(spark, sf_dir), directed=True)


def _paths_sql(graph: str, steps: str, sources: str, depth: int, share: str) -> str:
    """Shortest paths from the sources through each vertex: all pairs of distances and path counts."""
    return f"""with recursive {graph}, n as ({steps}), src as ({sources}),
      far as (select id as s, id as t, 0 as k from v union select far.s, n.d, far.k + 1 from far join n on far.t = n.s
        where far.k < {depth}),
      dist as materialized (select s, t, min(k) as k from far group by s, t),
      walk as (select id as s, id as t, 0 as k, 1.0::double as paths from v union all
        select walk.s, n.d, walk.k + 1, sum(walk.paths) from walk join n on walk.t = n.s
        join dist on dist.s = walk.s and dist.t = n.d and dist.k = walk.k + 1 group by walk.s, n.d, walk.k),
      b as (select x.t as id, sum(x.paths * y.paths / z.paths) * {share} as b from walk x join walk y on x.t = y.s
        join walk z on z.s = x.s and z.t = y.t where z.k = x.k + y.k and x.k > 0 and y.k > 0
        and x.s in (select id from src) group by x.t)
      select v.id, round(coalesce(b, 0.0), 6) as betweenness from v left join b on v.id = b.id"""


@_query(_paths_sql(_BULK, "select s, d from (select s, d from e union all select d, s from e) where s <> d",
                   "select id from v order by id limit 50", 12, "0.5"))
def betweenness_vids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the fifty smallest ids."""
    g = returned_together(spark, sf_dir, bulk=True)
    return _round(betweenness(g, g.vertices.orderBy("id").limit(50)), "betweenness")


@_query(_paths_sql("e as (select n_nationkey::bigint s, ((n_nationkey * 7 + k) % 25)::bigint d from nation, (values (1), (4)) t(k) "
                   "where n_nationkey <> (n_nationkey * 7 + k) % 25), v as (select s id from e union select d from e)",
                   "select distinct s, d from e", "select id from v", 30, "1.0"))
def betweenness_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each nation to the two that a rule over their numbers names."""
    n = F.col("n_nationkey")
    e = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("src"), F.explode(F.array(*[
        F.pmod(n * 7 + k, F.lit(25)) for k in (1, 4)])).alias("dst")).where("src <> dst")
    return _round(betweenness(Graph.from_edges(e)), "betweenness")


@_query(_paths_sql(_BULK, "select s, d from (select s, d from e union all select d, s from e) where s <> d",
                   "select id from v", 12, "0.5"), "betweenness")
def betweenness_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all sources."""
    return _round(betweenness(returned_together(spark, sf_dir, bulk=True)), "betweenness")


def _product(a: str, b: str) -> str:
    return f"select x.i, y.j, sum(x.v * y.v) as v from {a} x join {b} y on x.j = y.i group by x.i, y.j"


def _spectral_sql(which: str, directed: bool, nev: int, squarings: int = 22) -> str:
    """Leading pairs by powers: a matrix squared over and over tends to its first vector's outer product; deflate, repeat."""
    both = "" if directed else " union all select d, s, w from e"
    sql = f"""with {_TRADED}, a as materialized (select s as i, d as j, sum(w) as v from (select s, d, w from e{both}) group by 1, 2),
      ids as (select id from v), deg as (select i, sum(v) as d from a group by i), c as (select 1.0::double / count(*) as c from v)"""
    m = {"A": "select i, j, v from a", "Aug": "select i, j, v from a union all select i, i, d * c.c from deg, c",
         "L": "select i, j, -v as v from a union all select i, i, d from deg",
         "nL": "select a.i, a.j, -a.v / sqrt(x.d * y.d) as v from a join deg x on a.i = x.i join deg y on a.j = y.i union all select i, i, 1 from deg"}[which]
    full = "select p.id as i, q.id as j, coalesce(sum(v), 0.0::double) as v from ids p cross join ids q left join ({}) z on z.i = p.id and z.j = q.id group by 1, 2"
    sql += f", whole as materialized ({full.format(m)})"
    if directed:
        sql += ", back as (select j as i, i as j, v from whole), m0 as materialized (" + _product("whole", "back") + ")"
    elif which in ("L", "nL"):  # the smallest come first once the matrix is taken from a bound on its values
        sql += """, top as (select max(r) as t from (select sum(abs(v)) as r from whole group by i)),
          m0 as materialized (select i, j, case when i = j then top.t else 0 end - v as v from whole, top)"""
    else:
        sql += ", m0 as materialized (select * from whole)"
    picks = []
    for r in range(nev):
        p = f"m{r}"
        for k in range(squarings):
            sql += f", p{r}_{k} as materialized (select i, j, v / max(abs(v)) over () as v from ({_product(p, p)}))"
            p = f"p{r}_{k}"
        sql += f""", b{r} as (select i from {p} where i = j order by v desc, i limit 1),
          u{r} as (select i, v from {p} where j = (select i from b{r})),
          x{r} as materialized (select i, v / sqrt(sum(v * v) over ()) * (select case when v < 0 then -1 else 1 end from u{r} order by abs(v) desc, i limit 1) as v from u{r}),
          l{r} as materialized (select sum(x.v * m.v * y.v) as l from x{r} x join m{r} m on m.i = x.i join x{r} y on y.i = m.j),
          m{r + 1} as materialized (select m.i, m.j, m.v - l{r}.l * x.v * y.v as v from m{r} m join x{r} x on x.i = m.i join x{r} y on y.i = m.j, l{r})"""
        value = "sqrt(l)" if directed else "(select t from top) - l" if which in ("L", "nL") else "l"
        if directed:
            sql += f""", t{r} as (select w.j as i, sum(w.v * x.v) as v from whole w join x{r} x on x.i = w.i group by w.j),
              y{r} as materialized (select i, v / sqrt(sum(v * v) over ()) as v from t{r})"""
            picks.append(f"select x.i as id, {r + 1} as rank, x.v as value, {value} as eigenvalue, y.v as right_value from x{r} x join y{r} y on x.i = y.i, l{r}")
        else:
            picks.append(f"select i as id, {r + 1} as rank, v as value, {value} as eigenvalue from x{r}, l{r}")
    right = ", round(right_value, 5) + 0.0 as right_value" if directed else ""
    return sql + f""" select id, cast(rank as integer) as rank, round(value, 5) + 0.0 as value,
      round(eigenvalue, 5) + 0.0 as eigenvalue{right} from ({" union all ".join(picks)})"""


def _pairs(spark: SparkSession, found) -> DataFrame:
    """Vectors with their values; singular pairs with both vectors."""
    values = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(found.values)], "rank int, eigenvalue double")
    out = found.left.join(F.broadcast(values), "rank")
    if found.right is not None:
        out = out.join(found.right.withColumnRenamed("value", "right_value"), ["id", "rank"])
    return out.select("id", "rank", *[(F.round(c, n) + 0.0).alias(c) for c, n in (
        ("value", 5), ("eigenvalue", 5), ("right_value", 5)) if c in out.columns])


for _which, _directed in (("A", False), ("Aug", False), ("L", False), ("nL", False), ("A", True), ("Aug", True)):
    _query(_spectral_sql(_which, _directed, 3), f"spectral_{_which}{'_directed' * _directed}")(
        lambda spark, sf_dir, which=_which, directed=_directed: _pairs(
            spark, spectral_embedding(traded(spark, sf_dir, directed), 3, which)))


def _lloyd_sql(k: int, rounds: int) -> str:
    """Rounds of Lloyd's algorithm from the vectors with the smallest ids."""
    sql = f"""with x as (select vec_id as id, cast(embedding as double[]) as f from embeddings),
      c0 as (select row_number() over (order by id) as cluster, f as center from (select * from x order by id limit {k}))"""
    for i in range(rounds):
        sql += f""", a{i} as (select id, f, cluster from (select x.id, x.f, c.cluster, row_number() over (partition by x.id
          order by list_sum(list_transform(list_zip(x.f, c.center), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster) as r
          from x cross join c{i} c) where r = 1),
          u{i} as (select cluster, p, avg(f[p]) as m from a{i}, (select unnest(generate_series(1, 64)) as p) group by 1, 2),
          c{i + 1} as (select cluster, list(m order by p) as center from u{i} group by cluster)"""
    return sql + f""" select id, cast(cluster as integer) as cluster from (select x.id, c.cluster, row_number() over (partition by x.id
      order by list_sum(list_transform(list_zip(x.f, c.center), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster) as r
      from x cross join c{rounds} c) where r = 1"""


@_query(_lloyd_sql(4, 3), "kmeans")
def kmeans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return kmeans(rows, 4, max_iters=3, tol=0).cluster


def _sparse_lloyd_sql(graph: str, k: int, rounds: int) -> str:
    """Lloyd's rounds over adjacency rows, from the rows of the smallest ids."""
    sql = f"""with {graph}, a as (select s as i, d as j, 1.0::double as v from e union all select d, s, 1.0::double from e),
      first as (select id, row_number() over (order by id) as cluster from (select id from v order by id limit {k})),
      c0 as materialized (select cluster, j, v as m from a join first on a.i = first.id)"""
    for r in range(rounds + 1):
        sql += f""", n{r} as (select f.cluster, coalesce(sum(m * m), 0) as n from first f left join c{r} using (cluster) group by 1),
          d{r} as (select a.i, c.cluster, sum(a.v * c.m) as dot from a join c{r} c on a.j = c.j group by 1, 2),
          l{r} as materialized (select id, cluster from (select v.id, n.cluster, row_number() over (partition by v.id
            order by round(n.n - 2 * coalesce(d.dot, 0), 9), n.cluster) as p from v cross join n{r} n
            left join d{r} d on d.i = v.id and d.cluster = n.cluster) where p = 1),
          s{r} as (select cluster, count(*) as n from l{r} group by 1),
          c{r + 1} as materialized (select l.cluster, a.j, sum(a.v) / any_value(s.n) as m from a join l{r} l on a.i = l.id
            join s{r} s on s.cluster = l.cluster group by 1, 2
            union all select * from c{r} where cluster not in (select cluster from s{r}))"""
    return sql + f" select id, cast(cluster as integer) as cluster from l{rounds}"


@_query(_sparse_lloyd_sql(_TOGETHER, 4, 5))
def kmeans_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_graph(returned_together(spark, sf_dir), 4, 5, tol=0).cluster


@_query(_sparse_lloyd_sql(_TURN.replace("e as (", "e0 as (", 1).replace("from e union select d from e)", "from e0 union select d from e0)")
                          + ", e as (select distinct least(s, d) s, greatest(s, d) d from e0)", 6, 4))
def kmeans_adjacency_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the undirected graph of all returned parts."""
    g = returned_in_turn(spark, sf_dir)
    e = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return kmeans_graph(Graph(g.vertices, e, directed=False), 6, 4, tol=0).cluster
