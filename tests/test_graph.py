import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.functions import linalg
from vertexloom.graph import Graph
from vertexloom.operators import components, degree, kcore, kmeans, neighbours, pagerank, subgraph, triangles
from vertexloom.plans.scratch import Scratch
from vertexloom.sources import catalog, text
from vertexloom.streaming.degrees import windowed_degree


def graph(spark, edges, directed, n=None):
    df = spark.createDataFrame(edges, "src long, dst long")
    ids = spark.range(n) if n else None
    return Graph.from_edges(df, directed=directed, vertices=ids)


def as_dict(df, key="id"):
    rows = df.collect()
    value = [c for c in df.columns if c != key][0]
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r[value] for r in rows}


@pytest.fixture(scope="module")
def dirty():
    rng = random.Random(1)
    return [(rng.randrange(18), rng.randrange(18)) for _ in range(60)]  # with loops and repeats


def slow_core(edges, n):
    core = {}
    left = [e for e in edges if e[0] != e[1]]
    alive = set(range(n))
    k = 1
    while alive:
        while True:
            deg = {v: sum((a == v) + (b == v) for a, b in left) for v in alive}
            gone = {v for v in alive if deg[v] < k}
            if not gone:
                break
            core |= {v: k - 1 for v in gone}
            alive -= gone
            left = [(a, b) for a, b in left if a in alive and b in alive]
        k += 1
    return core


def test_degree_and_scan(spark, dirty):
    for directed in (True, False):
        g = graph(spark, dirty, directed, 20)
        want = {v: sum((a == v) + (b == v) for a, b in dirty) for v in range(20)}
        assert as_dict(degree.degree(g)) == want
        near = {v: {v} | {b for a, b in dirty if a == v} | {a for a, b in dirty if b == v} for v in range(20)}
        ball = near
        for order in (1, 2):
            assert as_dict(triangles.local_scan(g, order)) == {
                v: sum(a in ball[v] and b in ball[v] for a, b in dirty) for v in range(20)}
            ball = {v: set().union(*(near[w] for w in near[v])) for v in range(20)}
    g = graph(spark, dirty, True, 20)
    assert as_dict(degree.degree(g, "in")) == {v: sum(b == v for a, b in dirty) for v in range(20)}
    with pytest.raises(ValueError):
        degree.degree(g, "sideways")
    with pytest.raises(ValueError):
        triangles.local_scan(g, 3)
    top = triangles.topk_scan(g, 1, 100).collect()
    assert len(top) == 20 and [(-r.scan, r.vid) for r in top] == sorted((-r.scan, r.vid) for r in top)


@pytest.mark.parametrize("directed", [True, False])
def test_two_steps_on_a_sparse_graph_with_a_hub(spark, directed):
    rng = random.Random(6)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(36)] + [(0, v) for v in range(1, 9)] + [(5, 5), (30, 30), (31, 30)] * 2
    near = {v: {v} | {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in range(n)}
    ball = {v: set().union(*(near[w] for w in near[v])) for v in range(n)}
    got = as_dict(triangles.local_scan(graph(spark, edges, directed, n), 2))
    assert got == {v: sum(a in ball[v] and b in ball[v] for a, b in edges) for v in range(n)}


def test_two_step_rings_are_arrays_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    n = 30
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(30)] + [(0, v) for v in range(1, 12)] + [(7, 7), (8, 7), (8, 7)]
    near = {v: {v} | {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in range(n)}
    ball = {v: set().union(*(near[w] for w in near[v])) for v in range(n)}
    real, rings = Scratch.save, []

    def save(self, df, name="t"):
        out = real(self, df, name)
        if name == "ring":
            rings.append([(r.v, sorted(r.ids)) for r in out.collect()])
        return out

    monkeypatch.setattr(Scratch, "save", save)
    for limit in (triangles.RING_IDS, 4):
        monkeypatch.setattr(triangles, "RING_IDS", limit)
        got = as_dict(triangles.local_scan(graph(spark, edges, False, n), 2))
        assert got == {v: sum(a in ball[v] and b in ball[v] for a, b in edges) for v in range(n)}
    whole, cut = rings
    assert len(whole) == len({v for v, _ in whole}) < len(cut)
    assert dict(whole) == {v: sorted(ball[v] - near[v]) for v in range(n) if ball[v] - near[v]}


def test_triangles(spark, dirty):
    cycle = graph(spark, [(0, 1), (1, 2), (2, 0)], True)
    assert as_dict(triangles.triangles(cycle, "cycle")) == {0: 1, 1: 1, 2: 1}
    assert as_dict(triangles.local_scan(cycle)) == {0: 3, 1: 3, 2: 3}
    k4 = graph(spark, list(itertools.combinations(range(4), 2)), False)
    assert set(as_dict(triangles.triangles(k4)).values()) == {3}
    assert triangles.transitivity(k4).first()[0] == 1.0
    e = {(a, b) for a, b in dirty if a != b}
    want = {v: 0 for v in range(20)}
    for a, b, c in itertools.permutations(range(18), 3):
        if (a, b) in e and (b, c) in e and (c, a) in e:
            want[a] += 1
    assert as_dict(triangles.triangles(graph(spark, dirty, True, 20), "cycle")) == want
    star = graph(spark, [(0, i) for i in range(1, 5)], False)
    local = as_dict(triangles.transitivity(star, "local"))
    assert local[0] == 0 and all(np.isnan(local[i]) for i in range(1, 5))


def test_components(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)], False, 8)
    got = as_dict(components.clusters(g))
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: components.SENTINEL, 7: components.SENTINEL}
    big = components.largest_component(g)
    assert big.vcount == 3 and sorted(r.id for r in big.mapping.collect()) == [0, 1, 2]
    chain = graph(spark, [(i, i + 1) for i in range(60)], False)
    assert set(as_dict(components.clusters(chain)).values()) == {0}
    cycles = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5)], True)
    assert as_dict(components.clusters(cycles, "strong")) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert as_dict(components.clusters(cycles))[5] == 5


def test_pagerank(spark):
    cycle = graph(spark, [(0, 1), (1, 2), (2, 0)], True)
    assert all(abs(x - 1) < 1e-2 for x in as_dict(pagerank.pagerank(cycle)).values())
    with pytest.raises(ValueError):
        pagerank.pagerank(graph(spark, [(0, 1)], False))


def test_pagerank_blocks_spread_a_hub(spark):
    rng = random.Random(4)
    n = 60  # 55 to 59 are isolates; 0 has a third of all edges out, 1 as many in; repeats and a loop
    edges = [(0, v) for v in range(2, 52)] + [(v, 1) for v in range(2, 50)] + [(0, 2)] * 3 + [(5, 5), (1, 54)]
    edges += [(rng.randrange(2, 40), rng.randrange(n - 5)) for _ in range(50)]
    m = np.zeros((n, n))
    for a, b in edges:
        m[b, a] += 1
    m /= np.maximum(m.sum(0), 1)
    g = graph(spark, edges, True, n)
    for steps, tol in ((0, 0), (7, 0), (1000, None)):
        want = np.full(n, 0.15)
        for _ in range(steps):
            old, want = want, 0.15 + 0.85 * m @ want
            if tol is None and abs(want - old).max() <= 1.5e-4:
                break
        got = as_dict(pagerank.pagerank(g, steps, tol=tol))
        assert len(got) == n and all(abs(got[v] - want[v]) < 1e-12 for v in range(n))
    blocks, parts = pagerank._blocks(g, Scratch(spark, "test"), 4)
    held = [len(r.w) // 8 for r in blocks.collect()]
    assert parts == 4 and len(held) <= 4 and sum(held) == len(set(edges)) and max(held) < 0.6 * sum(held)


def test_kcore(spark, dirty):
    g = graph(spark, dirty, False, 20)
    want = slow_core(dirty, 20)
    assert as_dict(kcore.kcore(g, 1, 0)) == want
    assert as_dict(kcore.kcore(g, 2, 3)) == {v: max(c, 1) if c <= 3 else -1 for v, c in want.items()}


def test_kcore_goes_on_until_it_settles(spark):
    path = graph(spark, [(i, i + 1) for i in range(89)], False)  # takes 44 rounds, more than the SQL has
    assert set(as_dict(kcore.kcore(path, 1, 0)).values()) == {1}


def test_overlap_diameter_betweenness(spark):
    path = graph(spark, [(i, i + 1) for i in range(4)], False)
    assert neighbours.diameter(path).first()[0] == 4
    assert as_dict(neighbours.betweenness(path, batch=2)) == {0: 0, 1: 3, 2: 4, 3: 3, 4: 0}
    star = graph(spark, [(0, i) for i in range(1, 5)], True)
    got = {(r.vid_i, r.vid_j): r.overlap for r in neighbours.overlap(star, [1, 2]).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (2, 2): 1}
    line = graph(spark, [(0, 1), (1, 2)], True)
    assert as_dict(neighbours.betweenness(line)) == {0: 0, 1: 1, 2: 0}
    assert neighbours.diameter(line, directed=True).first()[0] <= 2
    with pytest.raises(ValueError):
        neighbours.overlap(path, [0])


def slow_steps(pairs, n):
    """All distances along pairs, as far as anything is reached."""
    far = {(v, v): 0 for v in range(n)}
    for k in range(n):
        far |= {(s, b): k + 1 for (s, t), x in list(far.items()) if x == k for a, b in pairs if a == t and (s, b) not in far}
    return far


@pytest.mark.parametrize("directed", [True, False])
def test_paths_match_brute_force(spark, directed):
    rng = random.Random(9)
    n = 11
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(17)]
    g = graph(spark, edges, directed, n)
    pairs = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b and not directed}
    far = slow_steps(pairs, n)
    count = {(v, v): 1 for v in range(n)}
    for (s, t), k in sorted(far.items(), key=lambda x: x[1]):
        if k:
            count[s, t] = sum(count[s, a] for a, b in pairs if b == t and far.get((s, a)) == k - 1)
    for vids in (None, [0, 3, 4]):
        want = {v: sum(count[s, v] * count[v, t] / count[s, t] for s, t in far if v not in (s, t) and (vids is None or s in vids)
                       and (s, v) in far and (v, t) in far and far[s, v] + far[v, t] == far[s, t]) for v in range(n)}
        got = as_dict(neighbours.betweenness(g, vids, batch=4))
        assert all(abs(got[v] - want[v] * (1 if directed else 0.5)) < 1e-9 for v in want)
    size = {v: sum((a == v) + (b == v) for a, b in edges) for v in range(n)}
    root = max(range(n), key=lambda v: (size[v], -v))
    reach = {t: k for (s, t), k in far.items() if s == root}
    end = max(reach, key=lambda v: (reach[v], -v))
    back = [k for (s, t), k in far.items() if (t if directed else s) == end]
    assert neighbours.diameter(g, directed=directed).first()[0] == max([*reach.values(), *back])
    if directed:
        assert as_dict(components.clusters(g, "strong")) == {
            v: min(u for u in range(n) if (u, v) in far and (v, u) in far) for v in range(n)}


def test_many_small_components_share_a_batch(spark, monkeypatch):
    edges = [(3 * i, 3 * i + 1) for i in range(40)] + [(3 * i + 1, 3 * i + 2) for i in range(30)]
    real, seen = neighbours._dependencies, []
    monkeypatch.setattr(neighbours, "_dependencies", lambda *a: seen.append(a[0].count()) or real(*a))
    got = as_dict(neighbours.betweenness(graph(spark, edges, False, 125), batch=8))
    assert got == {v: float(v % 3 == 1 and v < 90) for v in range(125)}
    assert seen == [90]  # pairs and isolates are no sources
    seen.clear()
    assert as_dict(neighbours.betweenness(graph(spark, edges[:1] * 9, False, 9), batch=2)) == dict.fromkeys(range(9), 0)
    assert not seen


def test_bad_arguments(spark):
    g = graph(spark, [(0, 1)], True)
    for order in (-1, 3):
        with pytest.raises(ValueError):
            triangles.local_scan(g, order)
    with pytest.raises(ValueError):
        kcore.kcore(g, 0)
    with pytest.raises(ValueError):
        kmeans.kmeans_graph(g, 0)


def test_subgraph_and_spmv(spark):
    g = graph(spark, [(0, 5), (5, 9), (9, 0), (2, 5)], True)
    sub = subgraph.induced(g, [0, 5, 9])
    assert sorted(map(tuple, sub.edges.collect())) == [(0, 1), (1, 2), (2, 0)] and sub.vcount == 3
    with pytest.raises(ValueError):
        subgraph.induced(g, [77])
    assert linalg.multiply(g).agg(F.sum("value")).first()[0] == g.ecount
    assert linalg.multiply(g, transpose=True).agg(F.sum("value")).first()[0] == g.ecount
    und = graph(spark, [(0, 1), (1, 2)], False)
    assert linalg.multiply(und).agg(F.sum("value")).first()[0] == 2 * und.ecount


def test_spectral(spark):
    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(7), 2))) for _ in range(12)})
    # a second component like the first: every value occurs twice
    edges += [(a + 7, b + 7) for a, b in edges]
    n = 14
    a = np.zeros((n, n))
    for i, j in edges:
        a[i, j] = a[j, i] = 1
    g = graph(spark, edges, False, n)
    d = np.diag(a.sum(1))
    for which, m in (("Aug", a + d / n), ("L", d - a)):
        got = linalg.spectral_embedding(g, 3, which)
        want = np.linalg.eigvalsh(m)
        want = want[:3] if which == "L" else want[np.argsort(-np.abs(want))][:3]
        assert np.allclose(got.values, want, atol=1e-7)
        x = np.zeros((n, 3))
        for row in got.vectors.collect():
            x[row.id, row.rank - 1] = row.value
        assert np.abs(m @ x - x * got.values).max() < 1e-6 and np.allclose(x.T @ x, np.eye(3), atol=1e-6)
    with pytest.raises(ValueError):
        linalg.spectral_embedding(graph(spark, edges, True, n), 2, "L")
    with pytest.raises(ValueError):
        linalg.spectral_embedding(g, 2, "B")


def test_kmeans(spark):
    rows = [(i, [float(i % 2 * 10 + i * 0.01), 1.0]) for i in range(20)]
    got = kmeans.kmeans(spark.createDataFrame(rows, "id long, features array<double>"), 2)
    labels = as_dict(got.cluster)
    assert len({labels[i] for i in range(0, 20, 2)}) == 1 and labels[0] != labels[1]
    assert sorted(r["size"] for r in got.sizes.collect()) == [10, 10]
    two = graph(spark, [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)], False)
    got = kmeans.kmeans_graph(two, 2, 4)
    labels = as_dict(got.cluster)
    assert set(labels) == set(range(6)) and len({labels[v] for v in (3, 4, 5)}) == 1
    assert {(r.cluster, r.id) for r in got.centers.collect()} >= {(labels[3], v) for v in (3, 4, 5)}


def test_sources(spark, tmp_path):
    f = tmp_path / "edges.txt"
    f.write_text("# comment\n0\t1\n\n4\t1\n")
    g = text.read_edge_list(spark, str(f), name="a b/c")
    assert g.name == "a_b_c" and g.vcount == 5 and g.ecount == 2 and repr(g) == "Graph a_b_c (D): 5 2"
    f2 = tmp_path / "weighted.txt"
    f2.write_text("1 2  3.5\n2   1 4\n")
    w = text.read_edge_list(spark, str(f2), attr="D", directed=False)
    assert w.edges.columns == ["src", "dst", "weight"] and w.simplify().edges.first().weight == 7.5
    root = str(tmp_path / "graphs")
    c = catalog.GraphCatalog(spark, root)
    c.register(g)
    assert c.exists("a b/c") and c.export("a_b_c") and not c.export("none")
    assert spark.sql("select count(*) from a_b_c_edges").first()[0] == 2
    fresh = catalog.GraphCatalog(spark, root)
    assert [tuple(r) for r in fresh.list_graphs().collect()] == [("a_b_c", False)]
    assert fresh.get("a_b_c").ecount == 2
    assert c.print("a_b_c", str(tmp_path / "out")) and not c.print("a_b_c", str(tmp_path / "out"))
    assert c.drop("a_b_c") and not c.drop("a_b_c")
    with pytest.raises(KeyError):
        catalog.GraphCatalog(spark).get("none")
    one = Graph.from_edges(spark.createDataFrame([(1, 2), (None, 3)], "from long, to long"), "from", "to", base=1)
    assert [tuple(r) for r in one.edges.collect()] == [(0, 1)]


def test_settings(spark, tmp_path):
    f = tmp_path / "conf.txt"
    f.write_text("spark.sql.shuffle.partitions = 4\nspark.executor.memory=1g\n# x\n")
    assert catalog.set_conf(spark, str(f)) == {"spark.sql.shuffle.partitions": "4"}
    assert catalog.set_conf(spark, str(tmp_path / "none")) == {}
    assert not catalog.set_log_level(spark, "loud") and catalog.set_log_level(spark, "error")
    assert catalog.get_params(spark, "engine")["spark.master"] == "local[4]"
    assert catalog.get_params(spark, "other") is None


def test_streaming_degree(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select 1L src, 2L dst, timestamp'2024-01-01 00:00:00' ts union all select 1L, 3L, timestamp'2024-01-01 00:01:00'"
              ).write.parquet(src)
    stream = spark.readStream.schema("src long, dst long, ts timestamp").parquet(src)
    q = windowed_degree(stream).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    assert as_dict(spark.sql("select id, degree from deg")) == {1: 2, 2: 1, 3: 1}
