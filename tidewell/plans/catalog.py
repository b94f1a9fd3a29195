"""Registry of the engine's own queries and of the SQL that says the same.

The driver's tables stand in for recordings: `events` is a sensor log (user_id a
recording, ts its clock, value a reading), `orders` the chapters of a customer,
`lineitem` packets and pixels, `embeddings` features and 8 x 8 tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import optics, rules
from tidewell.functions import quaternion as quat
from tidewell.functions.clock import micros, rational_key
from tidewell.operators import alignment, ordered, publish, raster

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_DAY = 86_400_000_000
_PI = repr(math.pi)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with an integer clock."""
    return table(spark, sf_dir, "events").withColumn("t", micros("ts"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as pixels: (vec_id, x, y, v integer)."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return cells.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.floor(F.col("e").cast("double") * 256).cast("long").alias("v"))


_TILES = "cells AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS e FROM embeddings), tiles AS (SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT) AS v FROM cells)"
_LOG = "log AS (SELECT *, epoch_us(ts) AS t FROM events)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_coverage(spark, sf_dir)


@query(f"""WITH {_LOG}, f AS (SELECT user_id, event_id, t FROM log WHERE event_type = 'view'), e AS (SELECT user_id, t, max(value) AS value FROM log WHERE event_type = 'click' GROUP BY 1, 2),
j AS (SELECT f.user_id, f.t, e.value FROM f ASOF LEFT JOIN e ON f.user_id = e.user_id AND f.t >= e.t),
g AS (SELECT user_id, max(d) AS max_gap_us FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM f) GROUP BY 1)
SELECT j.user_id, count(*) AS n_frames, count(j.value) AS n_covered, max(g.max_gap_us) AS max_gap_us FROM j JOIN g USING (user_id) GROUP BY 1""")
def asof_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reading applied at each frame, and how long the frames of a recording were apart."""
    rows = log(spark, sf_dir)
    frames = rows.where("event_type = 'view'").select("user_id", "t", "event_id")
    readings = rows.where("event_type = 'click'").select("user_id", "t", "value")
    joined = alignment.asof_join(frames, readings, ["user_id"], "t", ["value"], cell=_DAY)
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t"))
    return joined.withColumn("gap", gap).groupBy("user_id").agg(F.count("*").alias("n_frames"), F.count("value").alias("n_covered"), F.max("gap").alias("max_gap_us"))


@query(f"WITH {_LOG}, f AS (SELECT user_id, event_id, t FROM log WHERE event_type = 'view'), e AS (SELECT user_id, t, max(value) AS value FROM log WHERE event_type = 'click' GROUP BY 1, 2) SELECT f.user_id, f.event_id, f.t, e.t AS t_match, e.value FROM f ASOF LEFT JOIN e ON f.user_id = e.user_id AND f.t >= e.t")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return alignment.asof_join(rows.where("event_type = 'view'").select("user_id", "t", "event_id"), rows.where("event_type = 'click'"), ["user_id"], "t", ["value"], cell=_DAY)


@query(f"WITH {_LOG}, f AS (SELECT user_id, event_id, t FROM log WHERE event_type = 'view'), e AS (SELECT user_id, t, max(value) AS value FROM log WHERE event_type = 'click' GROUP BY 1, 2) SELECT f.user_id, f.event_id, f.t, e.t AS t_match, e.value FROM f ASOF LEFT JOIN e ON f.user_id = e.user_id AND f.t <= e.t")
def asof_forward_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return alignment.asof_join(rows.where("event_type = 'view'").select("user_id", "t", "event_id"), rows.where("event_type = 'click'"), ["user_id"], "t", ["value"], forward=True, cell=_DAY)


@query(f"""WITH {_LOG}, f AS (SELECT user_id, event_id, t FROM log WHERE event_type = 'view'), e AS (SELECT user_id, t, max(value) AS value FROM log WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT f.*, e.t AS t0, e.value AS v0 FROM f ASOF LEFT JOIN e ON f.user_id = e.user_id AND f.t >= e.t), a AS (SELECT b.*, e.t AS t1, e.value AS v1 FROM b ASOF LEFT JOIN e ON b.user_id = e.user_id AND b.t <= e.t)
SELECT user_id, event_id, t, round(CASE WHEN t0 IS NULL OR t1 IS NULL THEN NULL WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (CAST(t - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE)) END, 6) AS value FROM a""")
def asof_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    out = alignment.bracket_interp(rows.where("event_type = 'view'").select("user_id", "t", "event_id"), rows.where("event_type = 'click'").select("user_id", "t", "value"), ["user_id"], "t", "value", cell=_DAY)
    return out.select("user_id", "event_id", "t", F.round("value", 6).alias("value"))


@query(f"""WITH {_LOG}, v AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM log WHERE event_type = 'view'), c AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM log WHERE event_type = 'click'),
f AS (SELECT user_id, t FROM v WHERE n = 1), a AS (SELECT user_id, n AS anchor FROM (SELECT c.user_id, c.n, row_number() OVER (PARTITION BY c.user_id ORDER BY abs(c.t - f.t), c.n) AS k FROM c JOIN f USING (user_id)) WHERE k = 1)
SELECT v.user_id, v.n, v.t AS frame_t, c.t AS reading_t FROM v JOIN a USING (user_id) JOIN c ON c.user_id = v.user_id AND c.n = a.anchor + v.n - 1""")
def nearest_anchor_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame i with reading anchor + i; the anchor is nearest to the first frame, the earlier of two."""
    rows = log(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("t", "event_id")))
    frames = rows.where("event_type = 'view'").select("user_id", "n", F.col("t").alias("frame_t"))
    readings = rows.where("event_type = 'click'").select("user_id", F.col("n").alias("m"), F.col("t").alias("reading_t"))
    first = frames.where("n = 1").select("user_id", F.col("frame_t").alias("t0"))
    anchor = readings.join(first, "user_id").groupBy("user_id").agg(F.min(F.struct(F.abs(F.col("reading_t") - F.col("t0")), "m")).alias("a")).select("user_id", F.col("a.m").alias("anchor"))
    return frames.join(anchor, "user_id").withColumn("m", F.col("anchor") + F.col("n") - 1).join(readings, ["user_id", "m"]).select("user_id", "n", "frame_t", "reading_t")


@query(f"WITH {_LOG}, r AS (SELECT CAST(k AS BIGINT) AS chapter, min_t + k * {_DAY} AS s, min_t + (k + 1) * {_DAY} AS e FROM (SELECT min(t) AS min_t FROM log), range(5) x(k)) SELECT event_id, chapter, t - s AS local_t FROM log JOIN r ON t >= s AND t < e")
def interval_chapter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    starts = rows.agg(F.min("t").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("chapter"), "m")
    chapters = starts.select("chapter", (F.col("m") + F.col("chapter") * _DAY).alias("s"), (F.col("m") + (F.col("chapter") + 1) * _DAY).alias("e"))
    return alignment.interval_join(rows, chapters, "t", "s", "e", _DAY).select("event_id", "chapter", (F.col("t") - F.col("s")).alias("local_t"))


@query(f"WITH {_LOG}, b AS (SELECT min(t) + {_DAY} AS a, min(t) + 3 * {_DAY} AS z FROM log) SELECT event_id, t - min(t) OVER () AS rel FROM log, b WHERE t >= a AND t < z")
def half_open_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    bounds = rows.agg((F.min("t") + _DAY).alias("a"), (F.min("t") + 3 * _DAY).alias("z"))  # one row
    inside = rows.join(F.broadcast(bounds), (F.col("t") >= F.col("a")) & (F.col("t") < F.col("z"))).select("event_id", "t")
    first = inside.agg(F.min("t").alias("first"))
    return inside.join(F.broadcast(first)).select("event_id", (F.col("t") - F.col("first")).alias("rel"))


@query("""WITH a AS (SELECT l_suppkey, CAST(l_orderkey AS BIGINT) * 2 AS k, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2), b AS (SELECT l_suppkey, CAST(l_orderkey AS BIGINT) * 4 AS k, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2)
SELECT CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN 'matched' WHEN a.n IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS pair_status, count(*) AS n FROM a FULL OUTER JOIN b ON a.l_suppkey = b.l_suppkey AND a.k * 2 = b.k * 1 GROUP BY 1""")
def pair_join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tracks of time bases 1/2 and 1/4, paired where their clocks are equal as fractions."""
    rows = table(spark, sf_dir, "lineitem")
    a = rows.where("l_linenumber % 2 = 0").select("l_suppkey", (F.col("l_orderkey") * 2).alias("ticks_a")).distinct()
    b = rows.where("l_linenumber % 2 = 1").select("l_suppkey", (F.col("l_orderkey") * 4).alias("ticks_b")).distinct()
    both = alignment.pair_join(a, b, ["l_suppkey"], rational_key(F.col("ticks_a"), 1, 4), rational_key(F.col("ticks_b"), 1, 2))
    return both.groupBy("pair_status").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, CAST(coalesce(sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, cents FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)")
def chapter_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return ordered.running_start(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents").select("o_custkey", "o_orderkey", "start", "cents")


@query(f"WITH {_LOG}, d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM log) SELECT user_id, max(d) > 3600000000 AS has_gap, max(d) AS max_gap_us, min(d) AS min_interval_us, count(*) FILTER (WHERE d <= 0) AS n_violations FROM d GROUP BY 1")
def capture_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, least interval and clock violations of each recording: one window for the three."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    rows = log(spark, sf_dir).withColumn("d", step)
    return rows.groupBy("user_id").agg((F.max("d") > 3_600_000_000).alias("has_gap"), F.max("d").alias("max_gap_us"), F.min("d").alias("min_interval_us"), F.count(F.when(F.col("d") <= 0, 1)).alias("n_violations"))


@query("""WITH i AS (SELECT o_custkey, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + 30 * 86400000000 AS e, o_orderkey FROM orders), m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT o_custkey, reach AS gap_start, s AS gap_end FROM m WHERE reach < s""")
def coverage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches that no interval covers, by a running greatest end."""
    rows = table(spark, sf_dir, "orders").withColumn("s", micros("o_orderdate")).withColumn("e", F.col("s") + 30 * _DAY)
    before = Window.partitionBy("o_custkey").orderBy("s", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach", F.max("e").over(before)).where("reach < s").select("o_custkey", F.col("reach").alias("gap_start"), F.col("s").alias("gap_end"))


@query("SELECT CAST(i AS BIGINT) AS i, CAST(round(CAST(i AS DOUBLE) * 1e9 / 29.97) AS BIGINT) AS target_ns FROM range(30000) r(i)")
def sampled_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(30_000).select(F.col("id").alias("i"), F.round(F.col("id").cast("double") * 1e9 / 29.97).cast("long").alias("target_ns"))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS BIGINT) AS d, unnest(range(CAST(l_linenumber AS BIGINT))) AS k FROM lineitem)
SELECT l_suppkey, count(*) AS n, CAST(sum(p) AS BIGINT) AS sum_pts, max(p) AS last_pts FROM (SELECT l_suppkey, CAST(sum(d) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, d, k ROWS UNBOUNDED PRECEDING) - d AS BIGINT) AS p FROM r) GROUP BY 1""")
def pts_run_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of (count, delta) expanded to presentation times."""
    runs = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_quantity").cast("long"))
    each = runs.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("l_linenumber") - 1)))
    pts = ordered.running_start(each, ["l_suppkey"], ["l_orderkey", "l_partkey", "l_linenumber", "d", "k"], "d", "p")
    return pts.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("p").alias("sum_pts"), F.max("p").alias("last_pts"))


@query("SELECT l_suppkey, CAST(sum(CASE WHEN l_linenumber IN (4, 6) AND l_orderkey % 16 = 0 THEN l_orderkey // 16 ELSE 0 END) AS BIGINT) AS n_samples FROM lineitem GROUP BY 1")
def sample_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = F.col("l_linenumber").isin(4, 6) & (F.col("l_orderkey") % 16 == 0)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(fits, F.expr("l_orderkey div 16")).otherwise(0)).alias("n_samples"))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) FILTER (WHERE o_orderpriority = '1-URGENT') = 0 THEN 'absent' WHEN count(DISTINCT o_orderstatus) FILTER (WHERE o_orderpriority = '1-URGENT') = 1 THEN 'valid' ELSE 'conflict' END AS state, CASE WHEN count(DISTINCT o_orderstatus) FILTER (WHERE o_orderpriority = '1-URGENT') = 1 THEN min(o_orderstatus) FILTER (WHERE o_orderpriority = '1-URGENT') END AS value FROM orders GROUP BY 1")
def conflict_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent, valid or conflicting declarations: equal repeats are fine, differing ones are not."""
    declared = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(declared).alias("a"), F.max(declared).alias("b"))
    return rows.select("o_custkey", F.when(F.col("a").isNull(), "absent").when(F.col("a") == F.col("b"), "valid").otherwise("conflict").alias("state"), F.when(F.col("a") == F.col("b"), F.col("a")).alias("value"))


@query(f"WITH {_LOG} SELECT user_id, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), (t, event_id)) FILTER (WHERE event_type = 'view') AS last_view, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), (t, event_id)) FILTER (WHERE event_type = 'error') AS last_error FROM log GROUP BY 1")
def metadata_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value of each field of a recording."""
    rows = log(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.struct("t", "event_id", "k")))["k"]
    return rows.groupBy("user_id").agg(last("view").alias("last_view"), last("error").alias("last_error"))


@query("SELECT l_suppkey, l_returnflag, l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_partkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each key, as an aggregate: nothing is sorted and rows combine before the shuffle."""
    first = F.min(F.struct("l_orderkey", "l_partkey", "l_linenumber")).alias("f")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(first).select("l_suppkey", "l_returnflag", "f.l_orderkey", "f.l_partkey")


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS priority FROM orders GROUP BY 1")
def common_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(same("o_orderstatus").alias("status"), same("o_orderpriority").alias("priority"))


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part WHERE p_name LIKE '%widget%') WHERE k = 1")
def newest_version_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min(F.struct((-F.col("p_size")).alias("s"), "p_partkey", "p_size")).alias("b")
    return table(spark, sf_dir, "part").where(F.col("p_name").contains("widget")).groupBy("p_brand").agg(best).select("p_brand", "b.p_partkey", "b.p_size")


@query("SELECT vec_id, CASE WHEN s >= 0 THEN 1 ELSE 0 END AS decision FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(floor(CAST(embedding[i] AS DOUBLE) * 1024) AS BIGINT) * ((i * 7) % 11 - 5))) - 100 AS s FROM embeddings)")
def svm_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.lit([(i * 7) % 11 - 5 for i in range(1, 65)])
    terms = F.zip_with("embedding", weights, lambda x, w: F.floor(x.cast("double") * 1024).cast("long") * w)
    score = F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x) - 100
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(score >= 0, 1).otherwise(0).alias("decision"))


@query("SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS digest, CASE WHEN length(text) = n_chars THEN 'ok' ELSE 'wrong_length' END AS status FROM documents")
def digest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("digest"), F.when(F.length(text) == F.col("n_chars"), "ok").otherwise("wrong_length").alias("status"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def group_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups without members."""
    orders, members = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(members, orders.o_orderkey == members.l_orderkey, "left_anti").select("o_orderkey")


@query("SELECT c_custkey, regexp_extract(c_name, '^(.*)#([0-9]+)$', 1) AS kind, CAST(regexp_extract(c_name, '^(.*)#([0-9]+)$', 2) AS BIGINT) AS identity, replace(c_name, '#', '_') AS sibling FROM customer")
def pair_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.regexp_extract("c_name", "^(.*)#([0-9]+)$", i)
    return table(spark, sf_dir, "customer").select("c_custkey", part(1).alias("kind"), part(2).cast("long").alias("identity"), F.regexp_replace("c_name", "#", "_").alias("sibling"))


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON lower(regexp_replace('Nation ' || CAST(s.s_nationkey AS VARCHAR), '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(n.n_name, '[^A-Za-z0-9]', '', 'g'))")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names equal when case and punctuation are left out."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    suppliers = table(spark, sf_dir, "supplier").withColumn("alias", plain(F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))))
    return suppliers.join(table(spark, sf_dir, "nation").withColumn("alias", plain("n_name")), "alias").select("s_suppkey", "n_nationkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus WHEN o_orderpriority LIKE '4%' THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS effective, CASE WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '4%' THEN 'ambiguous' WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'conflict' ELSE 'ok' END AS status FROM orders")
def selection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit choice beats a detected one; what stays open is ambiguous, what cannot be is a conflict."""
    explicit = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    detected = F.when(~F.col("o_orderpriority").startswith("4"), F.substring("o_orderpriority", 1, 1))
    effective = F.coalesce(explicit, detected)
    status = F.when(effective.isNull(), "ambiguous").when((explicit == "F") & F.col("o_orderpriority").startswith("1"), "conflict").otherwise("ok")
    return table(spark, sf_dir, "orders").select("o_orderkey", effective.alias("effective"), status.alias("status"))


@query("WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, string_split(concat_ws('_', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)), '_') AS f FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, len(f) AS n_fields, CAST(list_sum(list_transform(f, lambda x: CAST(x AS BIGINT))) AS BIGINT) AS total FROM s")
def offset_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    rows = table(spark, sf_dir, "lineitem").withColumn("f", F.transform(F.split(text, "_"), lambda x: x.try_cast("long")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.size("f").cast("long").alias("n_fields"), F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS track FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region)")
def track_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionAll(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return both.select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("track"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((CAST(l_partkey % 65536 AS DOUBLE) - 32768) * 16 / 32768, 6) AS acc_g, round(radians((CAST(l_orderkey % 65536 AS DOUBLE) - 32768) * 2000 / 32768), 6) AS gyro FROM lineitem")
def axis_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = lambda c, full: (F.col(c) % 65536 - 32768).cast("double") * full / 32768
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(unit("l_partkey", 16), 6).alias("acc_g"), F.round(F.radians(unit("l_orderkey", 2000)), 6).alias("gyro"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) AS n FROM e), q AS (SELECT vec_id, e[1]/n AS w, e[2]/n AS x, e[3]/n AS y, e[4]/n AS z, e[5] AS a, e[6] AS b, e[7] AS c FROM n),
t AS (SELECT *, 2*(y*c-z*b) AS tx, 2*(z*a-x*c) AS ty, 2*(x*b-y*a) AS tz FROM q) SELECT vec_id, round(a+w*tx+y*tz-z*ty, 6) AS x, round(b+w*ty+z*tx-x*tz, 6) AS y, round(c+w*tz+x*ty-y*tx, 6) AS z FROM t""")
def quat_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quat.norm(quat.quaternion(*[e(i) for i in range(1, 5)])).alias("q"), F.struct(*[e(i).alias(n) for i, n in zip((5, 6, 7), "xyz", strict=True)]).alias("v"))
    return rows.select("vec_id", quat.rotate(F.col("q"), F.col("v")).alias("r")).select("vec_id", *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in "xyz"])


@query(f"WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, ((l_partkey % 512 + 0.5) / CAST(512 AS DOUBLE) - 0.5) * 2 * CAST({_PI} AS DOUBLE) AS lon, (0.5 - (l_orderkey % 256 + 0.5) / CAST(256 AS DOUBLE)) * CAST({_PI} AS DOUBLE) AS lat FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(cos(lat)*sin(lon), 6) AS x, round(sin(lat), 6) AS y, round(cos(lat)*cos(lon), 6) AS z FROM p")
def panorama_ray(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", optics.panorama_ray((F.col("l_partkey") % 512).cast("double"), (F.col("l_orderkey") % 256).cast("double"), 512, 256).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in "xyz"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, (9798 * (l_partkey % 256) + 19235 * (l_orderkey % 256) + 3735 * (l_suppkey % 256) + 16384) >> 15 AS grey, round(least(greatest(l_discount / 0.08 + 0.5, 0), 1), 6) AS alpha FROM lineitem")
def grey_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda c: F.col(c) % 256
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", optics.grey(byte("l_partkey"), byte("l_orderkey"), byte("l_suppkey")).alias("grey"), F.round(optics.overlap_alpha(F.col("l_discount"), 0.08), 6).alias("alpha"))


@query(f"WITH {_TILES} SELECT vec_id, x // 2 AS x, y // 2 AS y, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM tiles GROUP BY vec_id, x // 2, y // 2")
def pyramid_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return tiles(spark, sf_dir).groupBy("vec_id", half("x"), half("y")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@query(f"WITH {_TILES} SELECT vec_id, y, x, min(v) OVER w AS eroded, max(v) OVER w AS dilated FROM tiles WINDOW w AS (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def morph_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = Window.partitionBy("vec_id", "y").orderBy("x").rowsBetween(-1, 1)
    return tiles(spark, sf_dir).select("vec_id", "y", "x", F.min("v").over(near).alias("eroded"), F.max("v").over(near).alias("dilated"))


@query(f"WITH {_TILES}, c AS (SELECT vec_id, x, CAST(sum(v) AS BIGINT) AS s FROM tiles GROUP BY 1, 2), w AS (SELECT vec_id, x + k * 8 AS pl, x, k, s FROM c, (VALUES (-1), (0), (1)) t(k)) SELECT vec_id, x, round(m, 6) AS mean FROM (SELECT vec_id, x, k, avg(s) OVER (PARTITION BY vec_id ORDER BY pl RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM w) WHERE k = 0")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = tiles(spark, sf_dir).groupBy("vec_id", "x").agg(F.sum("v").alias("s"))
    return ordered.circular_mean(columns, ["vec_id"], "x", 8, F.col("s"), 2, 2).select("vec_id", "x", F.round("mean", 6).alias("mean"))


@query(f"WITH {_TILES}, o AS (SELECT a - 1 AS dx, b - 1 AS dy FROM range(3) p(a), range(3) q(b)), t AS (SELECT vec_id, x, y, CASE WHEN x + dx < 0 THEN -(x + dx) WHEN x + dx > 7 THEN 14 - (x + dx) ELSE x + dx END AS sx, CASE WHEN y + dy < 0 THEN -(y + dy) WHEN y + dy > 7 THEN 14 - (y + dy) ELSE y + dy END AS sy FROM tiles, o) SELECT t.vec_id, t.x, t.y, CAST(sum(s.v) AS BIGINT) AS box FROM t JOIN tiles s ON s.vec_id = t.vec_id AND s.x = t.sx AND s.y = t.sy GROUP BY 1, 2, 3")
def box_mean_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of 3 x 3 pixels, mirrored at the border: two windows along the axes, as the mean times nine is whole."""
    mean = raster.box_mean(tiles(spark, sf_dir), ["vec_id"], 8, 8, 1, ["v"])
    return mean.select("vec_id", "x", "y", F.round(F.col("v") * 9).cast("long").alias("box"))


@query("SELECT source, doc_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT source, doc_id, strlen(text) AS n FROM documents)")
def bundle_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("n"))
    return publish.bundle_index(rows, ["source"], ["doc_id"], "n")


@query(f"WITH {_LOG}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM log) SELECT event_id, user_id, CAST(sum(CASE WHEN d > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM d")
def session_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    return ordered.sessions(rows, ["user_id"], ["t", "event_id"], F.col("d") > 1_800_000_000).select("event_id", "user_id", "session")


@query(f"WITH {_LOG}, b AS (SELECT min(t) + {_DAY} AS a, min(t) + 2 * {_DAY} AS z FROM log) SELECT event_id, t - a AS pts, CAST(value * 1000000 AS BIGINT) AS duration FROM (SELECT * FROM log, b) WHERE t >= a AND t + CAST(value * 1000000 AS BIGINT) <= z")
def audio_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that lie in a range whole."""
    rows = log(spark, sf_dir).withColumn("duration", F.round(F.col("value") * 1_000_000).cast("long"))
    bounds = rows.agg((F.min("t") + _DAY).alias("a"), (F.min("t") + 2 * _DAY).alias("z"))
    inside = (F.col("t") >= F.col("a")) & (F.col("t") + F.col("duration") <= F.col("z"))
    return rows.join(F.broadcast(bounds), inside).select("event_id", (F.col("t") - F.col("a")).alias("pts"), "duration")


@query(f"""WITH RECURSIVE {_LOG}, o AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t, value) AS n FROM log), r AS (SELECT user_id, t, n, value AS ema FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.t, o.n, CASE WHEN o.t <= r.t THEN o.value ELSE 0.98 * r.ema + 0.02 * o.value END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, t, round(ema, 4) AS ema FROM r""")
def ema_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.ema_with_reset(log(spark, sf_dir), ["user_id"], "t", "value", 0.98, cell=64 * _DAY).select("user_id", "t", F.round("ema", 4).alias("ema"))


@query(f"WITH {_LOG} SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) % 10 = 0 AS infer, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) % 60 = 0 AS feature FROM log")
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1
    return log(spark, sf_dir).select("event_id", "user_id", (n % 10 == 0).alias("infer"), (n % 60 == 0).alias("feature"))


@query(f"WITH {_LOG}, c AS (SELECT user_id, event_id, t, CAST(round(value * 100) AS BIGINT) AS r FROM log), s AS (SELECT user_id, event_id, t, r, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - t, 0) // 1000000 AS d FROM c) SELECT user_id, event_id, CAST(sum(r * d) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS heading FROM s")
def gyro_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns about one axis add up, so the fold is a running sum of rate times time."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = log(spark, sf_dir).withColumn("r", F.round(F.col("value") * 100).cast("long")).withColumn("next", F.lead("t").over(order))
    rows = rows.withColumn("d", F.expr("coalesce(next - t, 0) div 1000000"))
    return rows.select("user_id", "event_id", F.sum(F.col("r") * F.col("d")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("heading"))


@query(f"WITH {_LOG} SELECT event_id, user_id, count(*) OVER w AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS total FROM log WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)")
def stationary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, 0)
    return log(spark, sf_dir).select("event_id", "user_id", F.count("*").over(hour).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).over(hour).alias("total"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS d FROM v q JOIN v c ON c.vec_id < 9),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, vec_id) AS k FROM s) SELECT query_id, bool_or(vec_id = 3) AS has_reference, max(CASE WHEN k = 1 THEN vec_id END) AS nearest FROM r WHERE k <= 5 GROUP BY 1""")
def top5_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the reference record is among the five nearest of nine, and which is nearest."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("e"))
    records = rows.where("vec_id < 9").select(F.col("vec_id").alias("c"), F.col("e").alias("f"))  # nine rows
    dot = F.aggregate(F.zip_with("e", "f", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    scored = rows.join(F.broadcast(records)).select(F.col("vec_id").alias("query_id"), F.struct((-dot).alias("d"), "c").alias("s"))
    best = scored.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("s")), 1, 5).alias("top"))
    return best.select("query_id", F.exists("top", lambda x: x["c"] == 3).alias("has_reference"), F.element_at("top", 1)["c"].alias("nearest"))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (CAST(l_partkey % 256 AS DOUBLE) - 16) * (255 / CAST(219 AS DOUBLE)) AS y, (CAST(l_orderkey % 256 AS DOUBLE) - 128) * (255 / CAST(224 AS DOUBLE)) AS u, (CAST(l_suppkey % 256 AS DOUBLE) - 128) * (255 / CAST(224 AS DOUBLE)) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(y + 2 * (1 - 0.2126) * v, 0), 255) + 1e-9, 4) AS r, round(least(greatest(y - 2 * 0.0722 * (1 - 0.0722) / 0.7152 * u - 2 * 0.2126 * (1 - 0.2126) / 0.7152 * v, 0), 255) + 1e-9, 4) AS g, round(least(greatest(y + 2 * (1 - 0.0722) * u, 0), 255) + 1e-9, 4) AS b FROM p")
def yuv_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda c: (F.col(c) % 256).cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", optics.yuv_to_rgb(byte("l_partkey"), byte("l_orderkey"), byte("l_suppkey")).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(F.col(f"c.{x}") + 1e-9, 4).alias(x) for x in "rgb"])  # exact halves fall one way


@query(f"WITH {_TILES}, m AS (SELECT vec_id, x, CAST(sum(abs(v)) AS BIGINT) AS s, count(*) AS n FROM tiles GROUP BY 1, 2) SELECT t.vec_id, t.x, count(*) AS kept, CAST(sum(t.v) AS BIGINT) AS total FROM tiles t JOIN m USING (vec_id, x) WHERE abs(t.v) * m.n < m.s + 30 * m.n GROUP BY 1, 2")
def two_pass_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each column over the pixels within 30 of its mean magnitude; the first pass is a window over the same rows."""
    column = Window.partitionBy("vec_id", "x")
    rows = tiles(spark, sf_dir).withColumn("s", F.sum(F.abs("v")).over(column)).withColumn("n", F.count("*").over(column))
    return rows.where("abs(v) * n < s + 30 * n").groupBy("vec_id", "x").agg(F.count("*").alias("kept"), F.sum("v").alias("total"))


@query(f"WITH {_TILES}, h AS (SELECT vec_id, v, count(*) AS n FROM tiles GROUP BY 1, 2), c AS (SELECT vec_id, v, sum(n) OVER (PARTITION BY vec_id ORDER BY v DESC) AS top FROM h), b AS (SELECT vec_id, max(v) AS threshold FROM c WHERE top >= 4 GROUP BY 1), a AS (SELECT vec_id, y * 8 + x AS place, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, y * 8 + x) AS k FROM tiles) SELECT b.vec_id, b.threshold, a.place FROM b JOIN a ON a.vec_id = b.vec_id AND a.k = 1")
def hist_top_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that the four brightest pixels reach, from a histogram counted from above, and the first brightest place."""
    pixels = tiles(spark, sf_dir).withColumn("place", F.col("y") * 8 + F.col("x"))
    above = F.sum("n").over(Window.partitionBy("vec_id").orderBy(F.col("v").desc()))
    bins = pixels.groupBy("vec_id", "v").agg(F.count("*").alias("n"), F.min("place").alias("place")).withColumn("top", above)
    best = F.max(F.struct("v", (-F.col("place")).alias("p")))
    return bins.groupBy("vec_id").agg(F.max(F.when(F.col("top") >= 4, F.col("v"))).alias("threshold"), best.alias("b")).select("vec_id", "threshold", (-F.col("b.p")).alias("place"))


@query("SELECT count(*) AS n, CAST(sum(l_partkey % 256) AS BIGINT) AS r, CAST(sum(l_orderkey % 256) AS BIGINT) AS g, CAST(sum(l_suppkey % 256) AS BIGINT) AS b FROM lineitem WHERE l_linenumber % 4 = 0")
def channel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda c: F.sum(F.col(c) % 256)
    return table(spark, sf_dir, "lineitem").where("l_linenumber % 4 = 0").agg(F.count("*").alias("n"), byte("l_partkey").alias("r"), byte("l_orderkey").alias("g"), byte("l_suppkey").alias("b"))


@query(f"WITH {_TILES}, p AS (SELECT vec_id, x + dx AS x, y + dy AS y, v, (2 - abs(dx)) * (2 - abs(dy)) AS w FROM tiles, (SELECT a - 1 AS dx FROM range(3) r(a)), (SELECT b - 1 AS dy FROM range(3) r(b)) WHERE x % 2 = 0 AND y % 2 = 0) SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(sum(w * v) AS BIGINT) AS votes, CAST(sum(w) AS BIGINT) AS weight FROM p WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY 1, 2, 3")
def patch_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second pixel spreads its value to its neighbours with tent weights."""
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit((2 - abs(a)) * (2 - abs(b))).alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    rows = tiles(spark, sf_dir).where("x % 2 = 0 AND y % 2 = 0").withColumn("d", F.explode(steps))
    rows = rows.select("vec_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), "v", F.col("d.w").alias("w"))
    return rows.where("x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7").groupBy("vec_id", "x", "y").agg(F.sum(F.col("w") * F.col("v")).alias("votes"), F.sum(F.col("w").cast("long")).alias("weight"))


@query(f"WITH {_LOG}, a AS (SELECT user_id, t, max(value) AS v FROM log WHERE event_id % 3 <> 0 GROUP BY 1, 2), b AS (SELECT user_id, t, max(value) AS v FROM log WHERE event_id % 3 <> 1 GROUP BY 1, 2) SELECT b.user_id, count(*) AS n, count(*) FILTER (WHERE a.t IS NULL) AS missing, count(*) FILTER (WHERE a.v <> b.v) AS differ FROM b LEFT JOIN a ON a.user_id = b.user_id AND a.t = b.t GROUP BY 1")
def overlap_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a second log held against the first: missing there, or of another value; one aggregate, no join."""
    rows = log(spark, sf_dir)
    in_a, in_b = F.col("event_id") % 3 != 0, F.col("event_id") % 3 != 1
    both = rows.groupBy("user_id", "t").agg(F.max(F.when(in_a, F.col("value"))).alias("a"), F.max(F.when(in_b, F.col("value"))).alias("b"))
    return both.where("b IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("a").isNull(), 1)).alias("missing"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("differ"))


@query("SELECT p_brand, count(DISTINCT lower(p_type)) AS n_names, CASE WHEN count(DISTINCT lower(p_type)) > 1 THEN 'ambiguous' ELSE min(lower(p_type)) END AS name FROM part GROUP BY 1")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.collect_set(F.lower("p_type"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(names.alias("s")).select("p_brand", F.size("s").cast("long").alias("n_names"), F.when(F.size("s") > 1, "ambiguous").otherwise(F.element_at("s", 1)).alias("name"))


@query("""WITH m AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'preserve' WHEN 1 THEN 'auto' ELSE 'log' END AS r, CASE o_custkey % 3 WHEN 0 THEN 'I_Log' WHEN 1 THEN 'log' END AS g, nullif(o_custkey % 5, 4) AS m, o_orderstatus = 'P' AS bad, o_orderpriority <> '5-LOW' AS lut FROM orders),
l AS (SELECT *, coalesce(g = 'I_Log', false) AS label, coalesce(m IN (1, 3), false) AS plain, CASE WHEN m = 2 THEN true WHEN m IS NULL OR m = 0 THEN coalesce(g = 'I_Log', false) ELSE false END AS is_log FROM m),
e AS (SELECT *, r <> 'preserve' AND (r = 'log' OR is_log) AS c, CASE WHEN r <> 'preserve' AND bad THEN 'malformed' WHEN r = 'auto' AND label AND plain THEN 'conflict' WHEN r = 'log' AND plain THEN 'not_log' WHEN r <> 'preserve' AND (r = 'log' OR is_log) AND NOT lut THEN 'no_lut' END AS error FROM l)
SELECT o_orderkey, CASE WHEN error IS NULL THEN c END AS "convert", error, coalesce(error, CASE WHEN m = 3 THEN 'high_range' END) AS panorama FROM e""")
def colour_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a recording's colours are converted, why not, and what a panorama of it would meet."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    requested = F.when(order % 3 == 0, "preserve").when(order % 3 == 1, "auto").otherwise("log")
    gamma, mode = F.when(customer % 3 == 0, "I_Log").when(customer % 3 == 1, "log"), F.nullif(customer % 5, F.lit(4))
    given = (requested, gamma, mode, F.col("o_orderstatus") == "P", F.col("o_orderpriority") != "5-LOW")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", rules.colour_conversion(*given).alias("r"), rules.colour_check(*given, F.lit(True)).alias("panorama"))
    return rows.select("o_orderkey", "r.convert", "r.error", "panorama")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def _load() -> None:
    """The other modules of queries register themselves here when imported."""
    for name in ("scalars", "recordings", "rasters", "geometry"):
        import_module(f"tidewell.plans.{name}")
