"""The registered queries: each operator over its whole table, in the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm.bpe import round_trip

    return round_trip(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm.secrets import scan_secrets

    docs = _read(spark, sf_dir, "documents")
    return scan_secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source")).drop("found")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm import warc
    from vertexloom.plans.scratch import Scratch

    path = Scratch(spark, "warc").path("archives")
    warc.write(_read(spark, sf_dir, "pages"), path)
    whole = F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", "path", "start", "gap")))
    return warc.read(spark, path, payloads=False).where(whole).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm.maxscore import top_k

    return top_k(_read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm.licenses import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm.wrappers import main_text

    return main_text(_read(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm.decontaminate import leaks

    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", F.round("share", 6).alias("share"))


def op8_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm.sharding import shard

    return shard(_read(spark, sf_dir, "documents"), "doc_id", [1.0] * 8, [1.0] * 9)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm.quality import predict, train

    docs = _read(spark, sf_dir, "documents")
    return predict(docs, train(docs, _read(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_warc, op3_bpe, op4_maxscore, op5_licenses, op6_html, op7_decontaminate, op8_rendezvous,
    op9_secrets, op10_quality)}


def _licenses_sql() -> str:
    """Every text against every template, shingle by shingle."""
    from vertexloom.llm.licenses import CONTAINMENT, SHINGLE, TEMPLATES, WORD

    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    words = lambda text: f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}')"
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(1, SHINGLE + 1))
    grams = f"list_transform(range(0, len(w) - {SHINGLE - 1}), lambda i: {shingle})"
    return f"""
        with t as (select license, list_distinct({grams}) as g from (
            select license, {words("body")} as w from (values {rows}) v(license, body))),
        s as (select license, len(g) as n, unnest(g) as h from t),
        d as (select row_number() over () as r, doc_id, {words("text")} as w from documents),
        e as (select r, doc_id, unnest({grams}) as h, unnest(range(0, len(w) - {SHINGLE - 1})) as p from d),
        m as (select r, any_value(doc_id) as doc_id, license, count(distinct h) / any_value(n)::double as containment,
                     min(p) as word from e join s using (h) group by r, license)
        select doc_id, license, containment, cast(word as integer) as word from m where containment >= {CONTAINMENT}"""


def _shards_sql() -> str:
    """The highest of the shards' draws wins, for eight shards and for nine."""
    from vertexloom.llm.sharding import DIGITS

    def winner(n: int) -> str:
        draws = ", ".join(f"{{'u': ('0x' || md5('{i}:' || k)[1:{DIGITS}])::bigint, 'i': {-i}}}" for i in range(n))
        return f"cast(-list_max([{draws}]).i as integer)"

    raw = "coalesce(text, '')"
    # the checksum byte by byte, from the table of its polynomial; a leading entry is the start value
    step = "xor(c >> 8, tab[(xor(c, b) & 255) + 1])"
    octets = f"list_transform(regexp_extract_all(hex(encode({raw})), '..'), lambda h: ('0x' || h)::bigint)"
    return f"""
        with tab as materialized (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) order by i) as tab from range(256) r(i)),
        d as (select doc_id, coalesce(cast(doc_id as varchar), 'null') as k, strlen({raw}) + 1 as size,
                xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: {step}), 4294967295) as text_crc32
              from documents, tab),
        p as (select *, {winner(8)} as shard, {winner(9)} as grown_shard from d)
        select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, shard,
               row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard
        from p"""


def _secrets_sql() -> str:
    """Spans by pattern, their places from the pieces between them, and the owners of their values."""
    from vertexloom.llm import secrets

    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                     for w in ("password", "passwd", "secret", "token", "api_?key"))
    base = {"assign": rf"""(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{24,}"}
    added = {"provider": secrets._PROVIDER.pattern, "mixed": secrets._MIXED.pattern}
    least = {"assign": 6, "access": 20, "hex": 24}
    mixed = """regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]')
        and len(value) - len(replace(value, '/', '')) <= 2 and list_aggregate(string_split(value, ''), 'entropy') >= 4.2"""
    parts, order = [], [*base, *added]
    for kind, pattern in (base | added).items():
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""select r, '{kind}' as kind, {order.index(kind)} as o, whole, value, begun from (
            select r, unnest(m) as whole, unnest(regexp_extract_all(t, {p}, {int(kind == "assign")})) as value,
              unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) as begun
            from (select r, t, regexp_extract_all(t, {p}) as m, regexp_split_to_array(t, {p}) as g from d) where len(m) > 0)""")
    keep = " or ".join(f"(kind = '{k}' and length(value) >= {n})" for k, n in least.items())
    free = "not exists (select 1 from {} y where y.r = x.r and y.begun < x.ended and x.begun < y.ended)"
    joined = "coalesce(string_agg(kind || ':' || begun || ':' || ended, ',' order by begun, o, ended){}, '')"
    n = "cast(count(*) filter (kind = '{}') as bigint) as n_{}"
    return f"""
        with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source, '') as owner,
              concat_ws('/', source, lang) as repo from documents),
        every as materialized (select r, kind, o, value, cast(begun as bigint) as begun, cast(begun + length(whole) as bigint) as ended
              from ({" union all ".join(parts)})),
        base as materialized (select * from every where {keep}),
        given as materialized (select * from every x where kind = 'provider' and {free.format("base")}),
        odd as (select * from every x where kind = 'mixed' and {mixed} and {free.format("base")} and {free.format("given")}),
        spans as materialized (from base union all from given union all from odd),
        owned as (select value, count(distinct owner) as owners from spans join d using (r) group by value),
        told as (select *, owners <= {secrets.MAX_OWNERS} as live from spans join owned using (value)),
        said as (select r, {n.format("assign", "assign")}, {n.format("access", "access")}, {n.format("hex", "hex")},
              sha256({joined.format(" filter (o < 3)")}) as base_sha256, {joined.format(" filter (o < 3 or live)")} as spans,
              cast(count(*) filter (live) as bigint) as n_live, cast(count(*) filter (not live) as bigint) as n_copied
              from told group by r)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans,
               coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
        from d left join said using (r)"""


ORACLE_SQL: dict[str, str] = {
    "op9_secrets": _secrets_sql(),
    "op5_licenses": _licenses_sql(),
    "op8_rendezvous": _shards_sql(),
    "op2_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
        g as (select *, max(page_id) over (partition by d) as top from p)
        select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
               case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id <> top then top end as refers_to
        from g""",
    "op4_maxscore": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
                   where embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from s)
        select query_id, cast(k as integer) as rank, vec_id, score from r where k <= 20""",
}
