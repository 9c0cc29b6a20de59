import hashlib
import html
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import bpe, decontaminate, licenses, maxscore, quality, secrets, sharding, simhash, warc, wrappers
from vertexloom.plans.scratch import Scratch

SMALL = "/root/testdata/sf0.001"
HAS_TABLES = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


def test_warc_round_trip_and_salvage(spark, tmp_path):
    big = "<p>é" + "x" * 1200 + "</p>"
    rows = [(1, "http://a/1", big, "p"), (2, None, big, "p"), (3, "http://a/ü", "small", "p"), (4, "u", "small", None),
            (5, "u", None, "p"), (6, "u", "", "p"), (9, "http://b", big, "p"), (None, "n", "other" * 300, "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/archives"
    warc.write(pages, path)
    got = warc.read(spark, path).where("gap is null").collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, text, _ in rows:
        raw = (text or "").encode()
        assert by[i].payload_bytes == len(raw) and by[i].payload_digest == hashlib.sha1(raw).hexdigest()
        assert by[i].record_type == ("revisit" if i in (1, 2) else "response")
        assert by[i].refers_to == (9 if i in (1, 2) else None)
        assert by[i].record_type == "revisit" or bytes(by[i].payload) == raw
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").where("gap is null").count() == 0


def test_salvage_finds_what_follows_damage():
    records = [warc.build_record(i, "http://x", os.urandom(50 * i), "0" * 40, 1) for i in range(1, 7)]
    parts = [warc.member(r) if i % 2 else r for i, r in enumerate(records)]
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    whole = b"".join(parts)
    assert [x[0] for x in warc.salvage(whole)] == ["record"] * 6
    broken = bytearray(whole)
    broken[starts[1] + 30] ^= 0xFF  # a compressed member
    broken[starts[4]] = 0  # a version line
    broken += b"trailing junk \x1f\x8b\x08 WARC/1."
    got = list(warc.salvage(bytes(broken)))
    assert [(k, s) for k, s, _, _ in got] == [
        ("record", 0), ("gap", starts[1]), ("record", starts[2]), ("record", starts[3]), ("gap", starts[4]),
        ("record", starts[5]), ("gap", starts[6])]
    assert [e for _, _, e, _ in got][:-1] == [s for _, s, _, _ in got][1:]  # no byte is unaccounted for
    assert list(warc.salvage(b"")) == []


def test_salvage_inside_members(spark, tmp_path):
    a, b, c = (warc.build_record(i, "http://x", bytes([65 + i]) * 500, hashlib.sha1(bytes([65 + i]) * 500).hexdigest(), None)
               for i in (1, 2, 3))
    bad = b.replace(b"BBBB", b"BxBB", 1) if b"BBBB" in b else b.replace(b"CCCC", b"CxCC", 1)
    whole = warc.member(a + bad + c)
    got = list(warc.salvage(whole))
    assert [k for k, *_ in got] == ["record", "gap", "record"] and {(s, e) for _, s, e, _ in got} == {(0, len(whole))}
    assert [x[0]["page-id"] for k, _, _, x in got if k == "record"] == ["1", "3"]
    # cut off in its last record: the first two are vouched for by their digests
    noise = [warc.build_record(i, "http://x", os.urandom(3000), hashlib.sha1(b"").hexdigest(), 9) for i in range(2)]
    noise.append(warc.build_record(7, "http://x", p := os.urandom(9000), hashlib.sha1(p).hexdigest(), None))
    cut = warc.member(b"".join(noise))[:-4000]
    after = warc.member(a)
    got = list(warc.salvage(cut + after))
    assert [k for k, *_ in got] == ["record", "record", "gap", "record"]
    assert got[2][1:3] == (0, len(cut)) and "2 records recovered" in got[2][3]
    # without any digest nothing vouches for what a broken member holds
    plain = re.sub(rb"WARC-(Block|Payload)-Digest: [^\r]*\r\n", b"", b"".join(noise))
    assert [k for k, *_ in warc.salvage(warc.member(plain)[:-4000])] == ["gap"]
    folder = tmp_path / "archives"
    folder.mkdir()
    (folder / "one.warc.gz").write_bytes(whole)
    (folder / "two.warc.gz").write_bytes(cut + after)
    rows = warc.read(spark, f"file://{folder}").collect()
    assert sorted(r.page_id for r in rows if r.gap is None) == [0, 1, 1, 1, 3] and sum(r.gap is not None for r in rows) == 2


@pytest.mark.parametrize("most", [0, 100])
def test_warc_of_shared_payloads(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    rows = [(i, "u", "x" * 2000 if i % 3 else f"{i}" * 300, 1, "k") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first long, key string")
    warc.write(pages, f"file://{tmp_path}/a")
    got = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    assert len(got) == 60 and {r.refers_to for i, r in got.items() if i % 3 and i != 59} == {59}
    assert all(r.record_type == ("revisit" if i % 3 and i != 59 else "response") for i, r in got.items())


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, 3.0]) for _ in range(6)], i) for i in range(300)]
    rows += [(400, None, 0), (420, [float("nan")] * 6, 0), (440, [None] + [1.0] * 5, 0), (460, [float("inf")] * 6, 0),
             (480, [1.0, 2.0], 0), (480, [1.0, 2.0], 0), (500, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 64)
    got = {}
    for r in maxscore.top_k(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    for q in got:  # every row that is not the query's own, repeats included
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for j, u in good if j == q for i, v in good if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)], q
    assert maxscore.top_k(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_licenses_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    names = sorted(licenses.TEMPLATES)
    filler = lambda n: " ".join(rng.choices("alpha beta gamma delta epsilon".split(), k=n))
    rows = [(i, filler(rng.randint(0, 150)) + " " + licenses.TEMPLATES[n].upper() + " " + filler(40), "x")
            for i, n in enumerate(names)]
    mit = licenses.TEMPLATES["mit"].split()
    rows += [(50, " ".join(w for i, w in enumerate(mit) if i != 40), "x"), (51, " ".join(mit[:40]), "x"),
             (52, None, None), (53, "", "x"), (54, "under five words", "x"), (55, filler(30_000) + licenses.TEMPLATES["isc"], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    words = lambda t: re.findall(r"[^\W_]+(?:[.-]+[^\W_]+)*", (t or "").lower())
    grams = lambda t: {tuple(w[i:i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    want = {(i, n): len(grams(t) & g) / len(g) for i, t, _ in rows for n in names for g in [grams(licenses.TEMPLATES[n])]}
    want = {k: v for k, v in want.items() if v >= 0.8}
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan_licenses(docs).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs, {}).count() == 0
    monkeypatch.setattr(licenses, "LITERAL_SHINGLES", 10)  # the join in place of the set, templates from a table
    table = spark.createDataFrame(list(licenses.TEMPLATES.items()), "license string, body string")
    assert {(r.doc_id, r.license): r.containment for r in licenses.scan_licenses(docs, table).collect()} == got
    twice = docs.where("doc_id = 3").unionAll(docs.where("doc_id = 3")).withColumn("doc_id", F.lit(None).cast("long"))
    each = licenses.scan_licenses(docs.where("doc_id = 3")).count()
    assert each and licenses.scan_licenses(twice).count() == 2 * each
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, {"short": "too few"})


def test_short_licenses_beside_long_ones(spark):
    names = sorted(licenses.TEMPLATES)
    texts = {(a, b, n): "alpha " * n + f"{licenses.TEMPLATES[a]} {licenses.TEMPLATES[b]}"
             for a in names for b in ("apache-2.0-header", "mit", "gpl-3.0-header") for n in (0, 32, 41)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    words = lambda t: re.findall(r"[^\W_]+(?:[.-]+[^\W_]+)*", t.lower())
    grams = lambda t: {tuple(w[i:i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    want = {(i, n) for i, t in enumerate(texts.values()) for n in names
            for g in [grams(licenses.TEMPLATES[n])] if len(grams(t) & g) >= 0.8 * len(g)}
    assert {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()} == want
    # templates whose parts repeat few shingles, and containments under the usual one
    odd = {"again": "one two three four five six " * 20, "mit": licenses.TEMPLATES["mit"]}
    half = " ".join(licenses.TEMPLATES["mit"].split()[:70])
    docs = spark.createDataFrame([(1, "one two three four five six " * 3 + licenses.TEMPLATES["mit"]), (2, half)],
                                 "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.scan_licenses(docs, odd).collect()} == {(1, "again"), (1, "mit")}
    assert {(r.doc_id, r.license) for r in licenses.scan_licenses(docs, odd, containment=0.3).collect()} == {
        (1, "again"), (1, "mit"), (2, "mit")}


@HAS_TABLES
def test_main_text_matches_plain_reading(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in wrappers.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        body = re.sub(r"</?b>|</?a(?: [^>]*)?>", "", body.replace("<br>", " "))
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1|h2)>", body)]
        assert got[r.page_id].text == "\n\n".join(filter(None, blocks))
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_main_text_of_odd_pages(spark):
    page = ('<html><body><div class="cookie-notice">We use cookies</div><nav>Menu</nav><div id="content"><h2>Title {0}</h2>'
            '<p>Body &amp; soul {0}\n of   the page, long enough to be seen.</p><p>Second {0} paragraph of running text.</p></div>'
            '<div class="comments"><p>Nice post</p></div><footer>Foot</footer></body></html>')
    rows = [(i, f"http://h/{i}", page.format(i), "x") for i in range(6)]
    rows += [(10, None, None, "x"), (11, "", "", "x"), (12, "http://h/z", "plain words only", "x"), (13, "::", "<p>Open <b>bold", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in wrappers.main_text(df).collect()}
    for i in range(6):
        assert got[i] == (f"Title {i}\n\nBody & soul {i} of the page, long enough to be seen.\n\n"
                          f"Second {i} paragraph of running text.")
    assert got[10] == "" and got[11] == "" and got[12] == "plain words only" and got[13] == "Open bold"
    assert wrappers.main_text(df.limit(0)).count() == 0
    a, b = wrappers.infer("<ul><li>a</li><li>b</li></ul>"), wrappers.infer("<ul><li>c</li></ul><p>more</p>")
    assert wrappers.expression(wrappers.merge(a, b)) == '(<ul>(<li>#TEXT</>)+</> (<p>#SAME</>)?)'


def test_copies_of_a_page_are_no_template(spark):
    page = ('<html><body><nav>Menu {0}</nav><div id="content"><h1>Lone title</h1><p>Seen {0} times</p>'
            '<p>{1} is a paragraph that is long enough to be running text of an article, since it goes on for well '
            'over a hundred and twenty characters.</p><ul><li>x</li></ul><p>Short end.</p></div></body></html>')
    short = '<html><body><div><h1>Lone title</h1><p>Some text {0}</p></div></body></html>'
    rows = [(i, "http://copies/", page.format(7, "This")) for i in range(5)]
    rows += [(10 + i, "http://counted/", page.format(i, "This")) for i in range(5)]
    rows += [(20 + i, "http://two/", page.format(i, f"Text {i % 2}")) for i in range(5)]
    rows += [(30 + i, "http://template/", page.format(i, f"Text {i}")) for i in range(5)]
    rows += [(40 + i, "http://short/", short.format(i)) for i in range(5)]
    rows += [(50 + i, "http://same/", short.format(1)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in wrappers.main_text(df).collect()}
    for i in range(5):
        for host in (0, 10, 20):
            assert got[host + i][0] == "Lone title" and got[host + i][-1] == "Short end." and len(got[host + i]) == 5
        assert "Lone title" not in got[30 + i] and "Short end." not in got[30 + i] and len(got[30 + i]) == 2
        assert got[40 + i] == [f"Some text {i}"] and got[50 + i] == ["Lone title", "Some text 1"]


def test_the_wrapper_decides(spark):
    """Unmarked articles of a host that marks others, and the template's texts inside marked articles."""
    body = "<p>{0} says something of its own that runs on for quite a while.</p><p>More about {0}.</p>"
    side = '<div class="x9"><p>Top stories of the day, and of the week, and of the month, for everyone who reads {1}.</p></div>'
    marked = "<body>" + side + '<div class="story" role="main">' + body + "<p>Share this with your friends</p></div></body>"
    plain = "<body>" + side + '<div class="story">' + body + "<p>Share this with your friends</p></div></body>"
    rows = [(i, "http://h/", marked.format(f"Page {i}", i)) for i in range(5)]
    rows += [(10 + i, "http://h/", plain.format(f"Page {10 + i}", i)) for i in range(3)]
    rows += [(20, "http://few/", marked.format("Page 20", 1)), (21, "http://few/", marked.format("Page 21", 2))]
    # one page that calls everything its main text does not speak for its host
    odd = plain.replace("<body>", '<body role="main">')
    rows += [(30 + i, "http://odd/", marked.format(f"Page {30 + i}", i)) for i in range(3)]
    rows += [(40, "http://odd/", odd.format("Page 40", 7))]
    # numbers in class names differ from page to page and do not tell places apart
    rows += [(50 + i, "http://numbers/", marked.replace("story", f"story post-{i}").format(f"Page {50 + i}", i)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: [f"Page {i} says something of its own that runs on for quite a while.", f"More about Page {i}."]
            for i, *_ in rows}
    for cut in (1, 4, 7):
        got = {r.page_id: r.text.split("\n\n") for r in wrappers.main_text(df.repartition(cut)).collect()}
        for i in want:
            assert got[i] == want[i] + ["Share this with your friends"] * (20 <= i < 30)
    alone = wrappers.extract(rows[6][2])
    assert "Top stories" in alone and "Share this" in alone  # by itself the page does not tell


def test_deep_and_wide_pages_are_read_whole():
    deep = "<div>" * 100_000 + "core" + "</div>" * 50_000 + "<p>after</p>" + "</div>" * 50_000 + "and this is the end"
    assert wrappers.extract(deep).split("\n\n") == ["core", "after", "and this is the end"]
    mixed = "".join(f"<div>{i}" for i in range(300)) + "".join(f"</div>t{i}" for i in range(300))
    out: list = []
    wrappers._blocks(wrappers.parse(mixed), out, "", frozenset())
    assert out == [str(i) for i in range(300)] + [f"t{i}" for i in range(300)]
    nav = "<div>" * 100 + "<nav>" + "<div>" * 100 + "menu" + "</div>" * 100 + "</nav>kept"
    assert wrappers.extract(nav) == "kept"
    spans = "<p>" + "<span>" * 50_000 + "text" + "</b>" * 50_000
    assert wrappers.extract(spans) == "text"
    wide = "".join(f'<div class="c{i}">{i}</div>' for i in range(5000))
    assert wrappers.extract(wide).split("\n\n") == [str(i) for i in range(5000)]
    w = wrappers.infer(wide)
    assert json.loads(json.dumps(wrappers.merge(w, wrappers.infer(deep))))[3] == 2
    assert len(w[2]) == 1 and w[4] == wrappers.merge(w, w)[4] / 2


def test_hosts_are_whole_over_flushes():
    hosts = [h for h in "abcdefg" for _ in range(5)]
    pages = [json.dumps(wrappers.infer(f"<p>{i}</p>")) for i in range(len(hosts))]
    for size in (1, 3, 4, 11):
        batches = [pa.RecordBatch.from_arrays([pa.array(hosts[a:a + size]), pa.array(pages[a:a + size])], names=["host", "wrapper"])
                   for a in range(0, len(hosts), size)]
        got = [r for b in wrappers._fold_hosts(json.loads, limit=2)(iter(batches)) for r in b.to_pylist()]
        assert [(r["host"], json.loads(r["wrapper"])[3]) for r in got] == [(h, 5) for h in "abcdefg"]


@HAS_TABLES
def test_latent_search_recalls_what_brute_force_finds(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    items = decontaminate.read_items([(r.item_id, r.text, None) for r in bench.collect()])
    items.idf = np.ones(len(items.vocabulary) + 1, np.float32)
    items.idf[0] = 0
    items.space = np.ones((len(items.idf), 1), np.float32) * items.idf[:, None]
    items.latent = np.ones((len(items.ids), 1), np.float32)
    monkeypatch.setattr(decontaminate, "COSINE", -2.0)  # every passage against every item
    rows = docs.select("doc_id", "text").collect()
    coded = [decontaminate._ids(items.vocabulary, r.text or "") for r in rows]
    want = {(rows[t].doc_id, i) for a in range(0, len(rows), 100)
            for t, i, _ in ((t + a, i, s) for t, i, s in decontaminate.Matcher(items).find(coded[a:a + 100]))}
    assert found <= want and len(found) >= 0.9 * len(want) and want


def test_the_latent_space_is_that_of_all_passages(spark):
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{i}" for i in range(300)])
    items = [(i, " ".join(rng.choice(vocabulary, 20))) for i in range(200)]  # more than the rank
    # words come in topics, so that the rows left out of a sample would turn the space
    rows = [(n, " ".join(rng.choice(vocabulary[n % 40 * 7:][:20], int(rng.integers(0, 130))))) for n in range(3000)]
    docs = spark.createDataFrame(rows + [(None, None), (5, "")], "doc_id long, text string")
    known = decontaminate.read_items([(*i, None) for i in items])
    scratch = Scratch(spark, "space")
    coded = scratch.save(decontaminate.coded_words(docs, known, "doc_id", "text"), "coded")
    got = decontaminate.fit_space(coded, known, scratch).latent

    codes = [decontaminate._ids(known.vocabulary, t) for _, t in rows]
    width = len(known.vocabulary) + 1
    df = np.sum([np.bincount(c, minlength=width) > 0 for c in codes], axis=0)
    df[0] = len(rows) + 2
    idf = decontaminate._weights(known, df)
    passages = [c[a:a + 48] for c in codes for a in range(0, len(c), 48)]

    def weighted(parts):
        m = np.stack([np.bincount(p, minlength=width) for p in parts]) * idf.astype(float)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

    p, own = weighted(passages), weighted(known.sequences)
    x = np.random.default_rng(3).normal(size=(width, decontaminate.RANK + decontaminate.OVERSAMPLE))
    for _ in range(decontaminate.POWER + 1):
        q = np.linalg.qr(x)[0]
        x = p.T @ (p @ q) + own.T @ (own @ q) * (len(rows) + 2) / len(own)
    latent = own @ np.linalg.svd(x, full_matrices=False)[0][:, :decontaminate.RANK]
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    assert np.abs(got @ got.T - latent @ latent.T).max() < 1e-3


def test_leaks_of_odd_rows(spark):
    item = "the quick brown fox jumps over one lazy dog near that old river bank today"
    noise = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame(
        [(1, f"{noise} {item.upper()}! {noise}", 1), (2, noise, 1), (3, None, 1), (4, "", None), (5, item, 1), (5, item, 1),
         (6, item.replace("brown ", "") + " " + noise, 1)], "doc_id long, text string, codes long")
    bench = spark.createDataFrame([(7, item, "a"), (8, None, "a"), (9, "...", "a"), (None, None, "a"), (None, item, "a")],
                                  "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 7), (5, 7), (6, 7)}
    kept = decontaminate.drop_leaks(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_paraphrases_with_inserted_words_are_found_wherever_they_start(spark):
    item = [f"item{i}" for i in range(16)]
    # eleven of sixteen words, the answer among them, with twelve words inserted
    said = " ".join(f"{w} other" if i < 10 else w for i, w in enumerate(item) if i not in (2, 4, 6, 8, 10))
    said = said.replace("item9 other", "item9 " + "other " * 8)
    docs = spark.createDataFrame([(n, "noise " * n + said + " noise" * 50) for n in range(48)], "doc_id long, text string")
    # rows of two halves in different texts hold nothing
    halves = [(100 + i, " ".join(item[8 * (i % 2):][:8])) for i in range(6)]
    halves += [(1000 + i, "noise") for i in range(700)]  # else the item's words are common and weigh nothing
    docs = docs.union(spark.createDataFrame(halves, "doc_id long, text string")).coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == set(range(48))


def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "", "same", "é" * i]), 1) for i in range(3000)] + [(None, "x", 1), (5, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part long").repartition(5)
    got = sharding.shard(df, "doc_id", [1.0] * 8, [1.0] * 9).collect()
    assert len(got) == len(rows)
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine))) and abs(len(mine) - 375) < 90
    assert all(r.grown_shard in (r.shard, 8) for r in got) and 200 < sum(r.grown_shard == 8 for r in got) < 470
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    sizes = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == sizes
    def bids(key, n):  # the plain reading: the highest of the shards' draws
        return max(range(n), key=lambda i: (int(hashlib.md5(f"{i}:{key}".encode()).hexdigest()[:13], 16), -i))

    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (bids(key, 8), bids(key, 9))
    heavy = sharding.shard(df, "doc_id", [1.0, 3.0, 0.0])
    n = {r.shard: r["count"] for r in heavy.groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and 2.4 < n[1] / n[0] < 3.7
    assert sharding.shard(df.limit(0), "doc_id", [1.0]).count() == 0


@HAS_TABLES
def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.predict(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 40 and sum(r.predicted == r.quality for r in scored) >= 0.95 * len(scored)
    assert all(0 <= r.score <= 1 for r in scored)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b", 1), (3, "a b", 1), (4, "word " * 60_000, 1)],
                                 "doc_id long, text string, score long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.predict(docs, quality.train(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (4, 0), (99, 1)], "doc_id long, quality int")
    got = quality.predict(docs, quality.train(docs, labels)).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 3}) == 1
    assert quality.predict(docs.limit(0), quality.train(docs, labels)).count() == 0
    assert [quality.within([3, 4, 5], m) for m in (1, 3, 6, 7, 12, 99)] == [1, 1, 1, 2, 3, 3]
    assert len(quality.encode_passages("word " * 60_000)) == -(-300_000 // quality.PASSAGE_BYTES)


def test_quality_reads_one_text_of_an_id_and_whole_bags(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.append((sorted(map(len, bags)), y.tolist())))
    docs = spark.createDataFrame([(i, f"{i} words " * 2000, 0) for i in range(30)] + [(3, "other", 0)] * 4, "doc_id long, text string, y long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    for rows in (docs, docs.repartition(7)):
        quality.train(rows, labels)
        quality.train(rows, labels, sample_passages=40)
    assert seen[0] == seen[2] and seen[1] == seen[3]
    assert len(seen[0][0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(30))
    assert sum(seen[1][0]) <= 40 and set(seen[1][0]) <= set(seen[0][0])


def test_attention_matches_plain_sums():
    rng = np.random.default_rng(5)
    bags, labels = [rng.normal(size=(n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 2, 5) * 4], np.tile([0.0, 1.0], 8)
    model = quality.fit(bags, labels)
    got = model.score(bags)
    w = model.w
    for bag, score in zip(bags, got):
        h = [np.tanh(np.clip((x - model.mean) / model.scale, -6, 6) @ w["W"] + w["b"]) for x in bag.astype(float)]
        e = [float(np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"]))) @ w["a"]) for v in h]
        share = [math.exp(x) / sum(map(math.exp, e)) for x in e]
        z = sum(s * v for s, v in zip(share, h))
        assert abs(score - 1 / (1 + math.exp(-(z @ w["c"] + w["d"])))) < 1e-9


def test_keep_one_keeps_rows_without_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 1), (2, "A b c d e", 1), (None, "a b c d e", 1), (1, "a b c d e", 1),
                                  (3, "quite another text here", 1)], "doc_id long, text string, fp long")
    clash = docs.withColumnRenamed("fp", "text_hash")
    assert simhash.keep_one(clash).columns == clash.columns and simhash.keep_one(clash).count() == 3
    kept = simhash.keep_one(docs)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "3", "None"] and kept.columns == docs.columns


@HAS_TABLES
def test_pipeline_matches_brute_force(spark, monkeypatch):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score([quality.encode_passages(r.text or "")])[0] >= quality.THRESHOLD]
    fps = {r.doc_id: simhash.fingerprint(r.text or "") for r in rows}
    group = {d: d for d in fps}
    for _ in fps:  # labels spread until nothing changes
        new = {d: min(group[o] for o in fps if (fps[o] ^ f).bit_count() <= 4) for d, f in fps.items()}
        if new == group:
            break
        group = new
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def leaks(text):
        w = decontaminate.words(text or "")
        return any(decontaminate.lcs_length(s, w[a:a + 16 * n]) >= 0.8 * len(s) for s in items
                   for n in [next(n for n in decontaminate.SPANS if (n - 1) * 16 >= len(s))] for a in range(0, max(1, len(w)), 16))

    rows = [r for r in rows if not leaks(r.text)]
    owners = {}
    for r in rows:
        for _, _, _, v in secrets.find(r.text or ""):
            owners.setdefault(v, set()).add(r.source)
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = {}
    for r in rows:
        text, done, parts = r.text or "", 0, []
        for _, s, e, v in secrets.find(text):
            if len(owners[v]) <= 1:
                if s >= done:
                    parts += [text[done:s], secrets.MASK]
                done = max(done, e)
        ids = lib.encode("".join([*parts, text[done:]]), add_special_tokens=False).ids
        want[r.doc_id] = len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert got == want
