"""Queries over recordings: order checks, selections, clock joins, decision tables and sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import rules
from tidewell.functions.clock import micros
from tidewell.operators import alignment, decisions, ordered, publish, sequences
from tidewell.plans.catalog import _LOG, log, query, table

_DAY = 86_400_000_000


@query(f"WITH {_LOG}, s AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM log) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE d <= 0) AS n_backward, bool_and(coalesce(d > 0, true)) AS strict FROM s GROUP BY 1")
def monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("event_id"))
    return log(spark, sf_dir).select("user_id", step.alias("d")).groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("d") <= 0, 1)).alias("n_backward"), F.bool_and(F.coalesce(F.col("d") > 0, F.lit(True))).alias("strict"))


@query(f"WITH {_LOG}, s AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM log) SELECT user_id, min(d) AS min_us, max(d) AS max_us FROM s WHERE d > 0 GROUP BY 1")
def min_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t"))
    return log(spark, sf_dir).select("user_id", step.alias("d")).where("d > 0").groupBy("user_id").agg(F.min("d").alias("min_us"), F.max("d").alias("max_us"))


@query(f"WITH {_LOG}, v AS (SELECT user_id, min(t) AS a, max(t) AS b FROM log GROUP BY 1) SELECT user_id, a AS first_us, b AS last_us, least(b, a + {_DAY}) - least(greatest(a, a + 3600000000), least(b, a + {_DAY})) AS clamped_us FROM v")
def track_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last clock of each recording, and how much of [first + 1 h, first + 1 day) it covers."""
    span = log(spark, sf_dir).groupBy("user_id").agg(F.min("t").alias("first_us"), F.max("t").alias("last_us"))
    end = F.least(F.col("last_us"), F.col("first_us") + _DAY)
    return span.withColumn("clamped_us", end - F.least(F.col("first_us") + 3_600_000_000, end))


@query(f"""WITH {_LOG}, k AS (SELECT user_id, t, max(event_id) AS key_id FROM log WHERE event_type = 'signup' GROUP BY 1, 2), s AS (SELECT user_id, event_id, t FROM log WHERE event_type = 'view')
SELECT s.user_id, s.event_id, k.key_id, s.t - k.t AS back_us FROM s ASOF LEFT JOIN k ON s.user_id = k.user_id AND s.t >= k.t""")
def packet_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key packet at or before each wanted time."""
    rows = log(spark, sf_dir)
    keys = rows.where("event_type = 'signup'").select("user_id", "t", F.col("event_id").alias("key_id"))
    wanted = rows.where("event_type = 'view'").select("user_id", "event_id", "t")
    found = alignment.asof_join(wanted, keys, ["user_id"], "t", ["key_id"], cell=_DAY)
    return found.select("user_id", "event_id", "key_id", (F.col("t") - F.col("t_match")).alias("back_us"))


@query(f"""WITH {_LOG}, f AS (SELECT user_id, event_id, t + 250000 AS t FROM log WHERE event_type = 'view'), e AS (SELECT user_id, t, max(value) AS value FROM log WHERE event_type = 'click' GROUP BY 1, 2), r AS (SELECT user_id, max(t) AS last FROM e GROUP BY 1)
SELECT f.user_id, f.event_id, CASE WHEN e.t IS NULL THEN 'before' WHEN f.t > r.last THEN 'after' ELSE 'covered' END AS status, CASE WHEN f.t <= r.last THEN e.value END AS value FROM f ASOF LEFT JOIN e ON f.user_id = e.user_id AND f.t >= e.t LEFT JOIN r ON r.user_id = f.user_id""")
def decoder_clock_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a clock that runs a quarter second behind, with the reading in force; outside the readings a status."""
    rows = log(spark, sf_dir)
    frames = rows.where("event_type = 'view'").select("user_id", "event_id", (F.col("t") + 250_000).alias("t"))
    readings = rows.where("event_type = 'click'").select("user_id", "t", "value")
    found = alignment.asof_join(frames, readings, ["user_id"], "t", ["value"], cell=_DAY)
    last = readings.groupBy("user_id").agg(F.max("t").alias("last"))
    both = found.join(last, "user_id", "left")
    status = F.when(F.col("t_match").isNull(), "before").when(F.col("t") > F.col("last"), "after").otherwise("covered")
    return both.select("user_id", "event_id", status.alias("status"), F.when(F.col("t") <= F.col("last"), F.col("value")).alias("value"))


@query(f"""WITH {_LOG}, p AS (SELECT user_id, t, max(value) AS h FROM log WHERE event_type = 'click' GROUP BY 1, 2), f AS (SELECT user_id, event_id, t FROM log WHERE event_type = 'view'),
a AS (SELECT f.*, p.t AS t0, p.h AS h0 FROM f ASOF LEFT JOIN p ON f.user_id = p.user_id AND f.t >= p.t), b AS (SELECT a.*, p.t AS t1, p.h AS h1 FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.t <= p.t),
k AS (SELECT *, CASE WHEN t1 = t0 THEN 0 ELSE (t - t0) / CAST(t1 - t0 AS DOUBLE) END AS k, radians(h0 % 180) / 2 AS q0, radians(h1 % 180) / 2 AS q1 FROM b WHERE t0 IS NOT NULL AND t1 IS NOT NULL), m AS (SELECT *, q0 + (q1 - q0) * k AS q FROM k)
SELECT user_id, event_id, round(cos(q), 3) AS w, round(sin(q), 3) AS y FROM m""")
def pose_bracket_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pose of each frame between its neighbours along the shorter arc; turns about one axis, so the arc is a line of angles."""
    from tidewell.functions import quaternion as quat

    rows = log(spark, sf_dir)
    poses = rows.where("event_type = 'click'").select("user_id", "t", F.col("value").alias("h"))
    frames = rows.where("event_type = 'view'").select("user_id", "event_id", "t")
    before = alignment.asof_join(frames, poses, ["user_id"], "t", ["h"], cell=_DAY).withColumnsRenamed({"t_match": "t0", "h": "h0"})
    after = alignment.asof_join(before, poses, ["user_id"], "t", ["h"], forward=True, cell=_DAY).withColumnsRenamed({"t_match": "t1", "h": "h1"}).where("t0 IS NOT NULL AND t1 IS NOT NULL")
    pose = lambda c: quat.quaternion(F.cos(F.radians(F.col(c) % 180) / 2), F.lit(0), F.sin(F.radians(F.col(c) % 180) / 2), F.lit(0))
    amount = F.when(F.col("t1") == F.col("t0"), 0.0).otherwise((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    found = after.select("user_id", "event_id", quat.slerp(pose("h0"), pose("h1"), amount).alias("q"))
    return found.select("user_id", "event_id", F.round("q.w", 3).alias("w"), F.round("q.y", 3).alias("y"))


@query("SELECT o_custkey, count(*) AS n, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN 'constant' ELSE 'conflict' END AS o_orderstatus, CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN 'constant' ELSE 'conflict' END AS o_orderpriority, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN 'constant' ELSE 'conflict' END AS y FROM orders GROUP BY 1")
def pair_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which properties the files of one recording agree on."""
    rows = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return decisions.agreement(rows, ["o_custkey"], ["o_orderstatus", "o_orderpriority", "y"])


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS t, o_orderstatus AS s FROM orders), n AS (SELECT *, lag(t) OVER w AS pt, lag(s) OVER w AS ps FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY t, o_orderkey))
SELECT o_custkey, o_orderkey, CASE WHEN pt IS NULL THEN 'first' WHEN ps <> s THEN 'profile' WHEN t - pt > {90 * _DAY} THEN 'gap' ELSE 'joins' END AS link FROM n""")
def chapter_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each chapter goes on from the one before."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("t"), F.col("o_orderstatus").alias("s"))
    order = Window.partitionBy("o_custkey").orderBy("t", "o_orderkey")
    rows = rows.withColumn("pt", F.lag("t").over(order)).withColumn("ps", F.lag("s").over(order))
    link = decisions.decide([(F.col("pt").isNull(), "first"), (F.col("ps") != F.col("s"), "profile"), (F.col("t") - F.col("pt") > 90 * _DAY, "gap")], "joins")
    return rows.select("o_custkey", "o_orderkey", link.alias("link"))


@query("""WITH c AS (SELECT p_partkey, p_size % 3 AS f, p_partkey % 3 AS t, CASE WHEN p_partkey % 11 < 8 THEN 2 ELSE p_partkey % 11 - 4 END AS cat, CASE WHEN p_size % 8 = 3 THEN 2 WHEN p_size % 4 <> 0 THEN 1 END AS rot, nullif(p_partkey % 7, 0) AS st, CASE WHEN p_size % 13 > 9 THEN p_size % 13 - 9 END AS rec, CASE p_partkey % 5 WHEN 1 THEN true WHEN 2 THEN false END AS turned, p_size > 25 AS packed FROM part),
e AS (SELECT *, CASE WHEN rot <> 1 THEN 'rotated' WHEN cat IN (1, 4, 5, 6) OR cat > 6 OR rec > 2 THEN 'projection' WHEN f = 1 AND t = 2 AND (st IN (1, 2) OR st > 4 OR rec = 1) THEN 'contradicts_tracks' WHEN f = 1 AND t = 2 AND turned IS NULL THEN 'order_undeclared'
WHEN f = 2 AND t = 1 AND (st IN (1, 3, 4) OR st > 4 OR rec = 2) THEN 'contradicts_pair' WHEN f = 1 AND t = 1 AND NOT packed THEN 'not_packed' WHEN NOT ((f = 1 AND t IN (1, 2)) OR (f = 2 AND t = 1)) THEN 'no_pair' END AS error FROM c)
SELECT p_partkey, CASE WHEN error IS NULL THEN CASE WHEN f = 1 AND t = 2 THEN 'dual_track' WHEN f = 2 THEN 'two_file' ELSE 'packed' END END AS layout, CASE WHEN error IS NULL THEN CASE WHEN f = 1 AND t = 2 THEN CAST(turned AS INTEGER) ELSE 0 END END AS first_track, error FROM e""")
def layout_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a recording's lenses are found, by its files, tracks and recorded codes."""
    size, key = F.col("p_size"), F.col("p_partkey")
    rotation = F.when(size % 8 == 3, 2).when(size % 4 != 0, 1)
    category, record = F.when(key % 11 < 8, 2).otherwise(key % 11 - 4), F.when(size % 13 > 9, size % 13 - 9)
    turned = F.when(key % 5 == 1, True).when(key % 5 == 2, False)
    found = rules.layout(size % 3, key % 3, category, rotation, F.nullif(key % 7, F.lit(0)), record, turned, size > 25)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("r")).select("p_partkey", "r.layout", "r.first_track", "r.error")


@query("""WITH o AS (SELECT p_partkey, CASE p_size % 14 WHEN 0 THEN NULL ELSE p_size % 14 END AS st, CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE p_partkey % 10 END AS g, CASE WHEN p_size > 45 THEN p_brand ELSE 'auto' END AS r FROM part),
n AS (SELECT *, CASE WHEN st = 6 THEN CASE g WHEN 1 THEN 'plastic_guard' WHEN 2 THEN 'glass_guard' WHEN 3 THEN 'bare' WHEN 4 THEN 'mean_guard' WHEN 5 THEN 'nd16' WHEN 6 THEN 'nd32' WHEN 7 THEN 'nd64' WHEN 8 THEN 'nd128' END
ELSE CASE st WHEN 0 THEN 'bare' WHEN 1 THEN 'sphere_guard' WHEN 2 THEN 'case_water' WHEN 3 THEN 'clear_case_water' WHEN 4 THEN 'plastic_guard' WHEN 5 THEN 'glass_guard' WHEN 7 THEN 'nd16' WHEN 8 THEN 'nd32' WHEN 9 THEN 'nd64' WHEN 10 THEN 'pro_case_water' WHEN 11 THEN 'pro_case_air' WHEN 12 THEN 'nd128' END END AS f FROM o)
SELECT p_partkey, CASE WHEN r <> 'auto' THEN r WHEN st IS NULL THEN 'auto' ELSE f END AS optics, CASE WHEN r <> 'auto' THEN NULL WHEN st = 6 AND (g IS NULL OR g = 0) THEN 'not_detected' WHEN st IS NOT NULL AND f IS NULL THEN 'unknown_code' END AS error FROM n""")
def recorded_optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optics that a recording states: by request, recorded state or detected guard."""
    size, key = F.col("p_size"), F.col("p_partkey")
    found = rules.recorded_optics(F.when(size > 45, F.col("p_brand")).otherwise("auto"), F.nullif(size % 14, F.lit(0)), F.when(key % 10 != 9, key % 10), "auto")
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("r")).select("p_partkey", "r.optics", "r.error")


@query("""WITH m AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(o_custkey % 97 AS DOUBLE) - 40 END AS ms, o_custkey % 5 < 4 AS raw, CASE WHEN o_orderkey % 11 = 0 THEN 2.0 ELSE 0.0 END AS lapse, o_custkey - 100 AS first, CASE WHEN o_orderkey % 7 = 0 THEN -1.0 ELSE 8.5 END AS sweep FROM orders)
SELECT o_orderkey, CASE WHEN flag AND ms IS NOT NULL THEN ms * 1000 WHEN flag IS NULL AND coalesce(ms, 0) <> 0 THEN NULL WHEN flag THEN NULL ELSE 0 END AS adjust_us, CASE WHEN flag AND ms IS NULL THEN 'missing' WHEN flag IS NULL AND coalesce(ms, 0) <> 0 THEN 'no_flag' END AS adjust_error,
CASE WHEN raw AND lapse <= 0 AND first >= 0 THEN first END AS start_us, CASE WHEN lapse <> 0 THEN 'time_lapse' WHEN sweep < 0 THEN 'readout' END AS timing FROM m""")
def timing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock adjustment, capture start and whether the clocks can be followed."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    flag = F.when(order % 3 == 0, True).when(order % 3 == 1, False)
    ms = F.when(customer % 4 == 1, F.lit(0.0)).when(customer % 4 != 0, (customer % 97).cast("double") - 40)
    lapse, sweep, none = F.when(order % 11 == 0, 2.0).otherwise(0.0), F.when(order % 7 == 0, -1.0).otherwise(8.5), F.lit(None).cast("long")
    adjust = rules.gyro_adjustment(flag, ms)
    start = rules.capture_start(customer % 5 < 4, lapse, none, customer - 100)
    followed = rules.timing(F.array(F.lit(7)), lapse, none, sweep)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", adjust.alias("a"), start.alias("start_us"), followed.alias("timing"))
    return rows.select("o_orderkey", F.col("a.us").alias("adjust_us"), F.col("a.error").alias("adjust_error"), "start_us", "timing")


_FILE = "'d' || (p_partkey % 40) || '/' || CASE WHEN p_size % 5 = 0 THEN 'odd_' || (p_partkey % 300) ELSE 'v_' || (p_partkey % 150) || CASE WHEN p_size % 2 = 0 THEN '_00_' ELSE '_10_' END || '1' END || '.rec'"


@query(f"""WITH f AS (SELECT {_FILE} AS path FROM part), n AS (SELECT path, regexp_extract(path, '^[^/]*/') AS folder, regexp_extract(path, '[^/]*$') AS name FROM f),
k AS (SELECT path, folder, CASE WHEN contains(name, '_00_') THEN 'p' WHEN contains(name, '_10_') THEN 's' ELSE 'a' END AS kind, CASE WHEN contains(name, '_00_') OR contains(name, '_10_') THEN regexp_replace(upper(name), CASE WHEN contains(name, '_00_') THEN '_00_' ELSE '_10_' END, '_XX_') ELSE name END AS identity FROM n),
g AS (SELECT folder, identity, count(*) FILTER (kind = 'p') AS p, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 'a') AS a FROM k GROUP BY 1, 2)
SELECT folder, identity, CAST((p > 0)::INT + (s > 0)::INT + (a > 0)::INT AS INTEGER) AS n_paths, CASE WHEN p > 1 OR s > 1 OR a > 1 THEN 'duplicate' WHEN p = 0 AND s > 0 THEN 'no_primary' END AS error FROM g""")
def input_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put together by their names: a lens file and its sibling, the primary first."""
    found = sequences.input_sets(table(spark, sf_dir, "part").select(F.expr(_FILE).alias("path")), extension="rec")
    return found.select("folder", "identity", F.size("paths").alias("n_paths"), "error")


@query("""WITH c AS (SELECT o_orderkey AS recording, o_custkey % 3 > 0 AS split, o_orderkey % 50 = 0 AS invalid, CASE WHEN o_custkey % 10 = 7 THEN '' ELSE 'c' || o_custkey END AS identity, o_custkey % 2 AS capture_type, o_orderkey % 1000 AS idx, CASE WHEN o_orderkey % 5 = 0 THEN 9 WHEN o_orderkey % 97 = 0 THEN 8 ELSE 0 END AS total, 1 + o_orderkey % 7 AS duration, o_orderkey % 60 = 1 AS odd FROM orders),
n AS (SELECT *, split AND identity <> '' AND NOT invalid AS named FROM c), k AS (SELECT *, CASE WHEN named THEN identity || ':' || capture_type ELSE 'r' || recording END AS g FROM n),
a AS (SELECT g, count(*) AS n_chapters, count(DISTINCT idx) AS n_idx, min(nullif(total, 0)) AS low, max(nullif(total, 0)) AS high, min(odd::INT) AS least, max(odd::INT) AS most, max((split AND NOT named)::INT) AS unnamed FROM k GROUP BY 1)
SELECT recording, n_chapters, CAST(coalesce(sum(duration) OVER (PARTITION BY g ORDER BY idx, recording ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, NOT split AS complete, CASE WHEN unnamed = 1 THEN 'no_identity' WHEN low <> high THEN 'totals' WHEN least <> most THEN 'incompatible' WHEN n_chapters > 1 AND n_idx < n_chapters THEN 'duplicate_index' END AS error FROM k JOIN a USING (g)""")
def chapter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of split captures put together, checked and laid end to end."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        order.alias("recording"), (customer % 3 > 0).alias("split"), (order % 50 == 0).alias("invalid"), F.when(customer % 10 == 7, "").otherwise(F.concat(F.lit("c"), customer)).alias("identity"), (customer % 2).alias("capture_type"),
        (order % 1000).alias("idx"), F.when(order % 5 == 0, 9).when(order % 97 == 0, 8).otherwise(0).alias("total"), (1 + order % 7).alias("duration"), (order % 60 == 1).alias("odd"),
    )
    return sequences.chapters(rows, ["odd"]).select("recording", "n_chapters", "start", "complete", "error")


@query("SELECT p_partkey, (p_size > 5 AND (p_size % 4 = 0 OR lower(p_brand) = 'brand#1' OR lower(p_brand) = 'brand#12') AND (p_size % 3 = 0 OR p_type = 'ECONOMY')) AS allowed FROM part")
def asset_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified assets whose lists name the camera in either case and the lens; an empty list is a wildcard."""
    none = F.array().cast("array<string>")
    cameras = F.when(F.col("p_size") % 4 == 0, none).otherwise(F.array(F.lit("BRAND#1"), F.lit("BRAND#12")))
    lenses = F.when(F.col("p_size") % 3 == 0, none).otherwise(F.array(F.lit("ECONOMY")))
    fine = (F.col("p_size") > 5) & decisions.allowed(F.col("p_brand"), cameras, fold=True) & decisions.allowed(F.col("p_type"), lenses)
    return table(spark, sf_dir, "part").select("p_partkey", fine.alias("allowed"))


@query("SELECT page_id, (length(p) > 0 AND p NOT LIKE '/%' AND NOT contains(p, chr(92)) AND NOT contains(p, ':') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0) AS safe FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN '../' || page_id WHEN 3 THEN '/' || page_id ELSE 'a/b' || page_id END AS p FROM pages)")
def relative_path_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, k, n = F.col("url"), F.col("page_id") % 5, F.col("page_id").cast("string")
    path = decisions.decide([(k == 0, url), (k == 1, F.regexp_replace(url, "^[a-z]+://", "")), (k == 2, F.concat(F.lit("../"), n)), (k == 3, F.concat(F.lit("/"), n))], F.concat(F.lit("a/b"), n))
    return table(spark, sf_dir, "pages").select("page_id", decisions.safe_relative(path).alias("safe"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 45 THEN 101 ELSE CAST(l_quantity AS INTEGER) END AS q, l_partkey % 13 = 0 AS there, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 2 * (l_partkey % 9) + CAST(l_partkey % 4 = 3 AS INTEGER) END AS w, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey % 9 END AS h,
CASE l_orderkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'legacy' ELSE 'ai' END AS mode, CASE WHEN l_partkey % 4 = 0 THEN l_discount * 11 END AS strength, CASE WHEN l_partkey % 5 = 0 THEN l_tax END AS balance, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber END AS style FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q < 1 OR q > 100 THEN 'quality' WHEN there THEN 'exists' WHEN w IS NOT NULL AND NOT (w > 0 AND h > 0 AND w = 2 * h) THEN 'size' WHEN w % 2 <> 0 OR h % 2 <> 0 THEN 'odd_size' END AS export,
CASE WHEN strength < 0 OR strength > 1 THEN 'strength' WHEN balance < 0 OR balance > 1 THEN 'balance' WHEN mode = 'off' AND (strength IS NOT NULL OR balance IS NOT NULL OR style IS NOT NULL) THEN 'needs_mode' WHEN mode = 'legacy' AND style IS NOT NULL THEN 'style_needs_ai' WHEN mode = 'ai' AND balance IS NOT NULL THEN 'balance_needs_legacy' WHEN mode = 'ai' AND (style < 0 OR style > 3) THEN 'style' END AS underwater FROM o""")
def options_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that an export's options break, and the first that a restoration's do."""
    part, line, order = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_orderkey")
    sized = line % 3 != 0
    export = rules.export_options(F.when(F.col("l_quantity") > 45, 101).otherwise(F.col("l_quantity").cast("int")), part % 13 == 0, F.when(sized, 2 * (part % 9) + (part % 4 == 3).cast("int")), F.when(sized, part % 9))
    mode = F.when(order % 3 == 0, "off").when(order % 3 == 1, "legacy").otherwise("ai")
    water = rules.underwater_options(mode, F.when(part % 4 == 0, F.col("l_discount") * 11), F.when(part % 5 == 0, F.col("l_tax")), F.when(part % 3 == 0, line))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", export.alias("export"), water.alias("underwater"))


@query("""WITH s AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f FROM orders GROUP BY 1)
SELECT c.c_custkey, CASE WHEN c.c_mktsegment <> 'MACHINERY' THEN c.c_mktsegment WHEN s.o > 0 AND s.f > 0 THEN 'ambiguous' WHEN s.o > 0 THEN 'open' WHEN s.f > 0 THEN 'final' ELSE 'ambiguous' END AS choice FROM customer c LEFT JOIN s ON s.o_custkey = c.c_custkey""")
def optics_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit choice, else what all the evidence agrees on, else ambiguous."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus IN ('O', 'F')").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b"))
    detected = decisions.decide([(F.col("a") != F.col("b"), "ambiguous"), (F.col("a") == "O", "open"), (F.col("a") == "F", "final")], "ambiguous")
    both = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(seen, "c_custkey", "left")
    return both.select("c_custkey", decisions.merged(F.col("c_mktsegment"), detected, auto="MACHINERY").alias("choice"))


@query("""WITH l AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), o AS (SELECT p_type, count(*) AS owners, min(p_brand) AS owner FROM l GROUP BY 1)
SELECT p.p_partkey, CASE WHEN o.owners = 1 THEN o.owner END AS camera, o.owners FROM part p JOIN o USING (p_type)""")
def camera_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one camera that owns a lens, none where several do."""
    parts = table(spark, sf_dir, "part")
    owners = parts.groupBy("p_type").agg(F.countDistinct("p_brand").alias("owners"), F.min("p_brand").alias("owner"))
    return parts.select("p_partkey", "p_type").join(owners, "p_type").select("p_partkey", F.when(F.col("owners") == 1, F.col("owner")).alias("camera"), "owners")


@query(f"""WITH {_LOG}, c AS (SELECT user_id, (t // {_DAY}) AS chapter, min(t) AS origin FROM log GROUP BY 1, 2), p AS (SELECT l.user_id, l.event_id, l.t - c.origin AS local, c.chapter, c.chapter * {_DAY} AS start, l.event_type FROM log l JOIN c ON l.user_id = c.user_id AND l.t // {_DAY} = c.chapter),
k AS (SELECT user_id, event_id, start + local AS dts FROM p WHERE event_type <> 'click' OR local < 43200000000), g AS (SELECT user_id, event_id, dts, dts > coalesce(lag(dts) OVER (PARTITION BY user_id ORDER BY dts, event_id), -1) AS rising FROM k)
SELECT user_id, count(*) AS n_packets, max(dts) AS last_dts, bool_and(rising) AS copyable FROM g GROUP BY 1""")
def packet_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of all chapters on one clock: moved to the chapter's start, audio outside it dropped, clocks that stand forbid the copy."""
    rows = log(spark, sf_dir).withColumn("chapter", F.expr(f"t div {_DAY}"))
    origin = Window.partitionBy("user_id", "chapter")
    rows = rows.withColumn("local", F.col("t") - F.min("t").over(origin)).where("event_type <> 'click' OR local < 43200000000")
    rows = rows.select("user_id", "event_id", (F.col("chapter") * _DAY + F.col("local")).alias("dts"))
    before = F.lag("dts").over(Window.partitionBy("user_id").orderBy("dts", "event_id"))
    rows = rows.withColumn("rising", F.col("dts") > F.coalesce(before, F.lit(-1)))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_packets"), F.max("dts").alias("last_dts"), F.bool_and("rising").alias("copyable"))


@query(f"WITH {_LOG}, s AS (SELECT user_id, event_id, t, min(t) OVER (PARTITION BY user_id) AS t0 FROM log) SELECT user_id, event_id, '{{\"sample\":' || event_id || ',\"source\":\"' || t || '\"' || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',\"timeline\":\"' || (t - t0) * 1000 || '\"' END || '}}' AS line FROM s")
def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line a sample; clocks are text, and one that cannot be mapped is left out."""
    start = F.min("t").over(Window.partitionBy("user_id"))
    rows = log(spark, sf_dir).withColumn("timeline", F.when(F.col("event_id") % 4 != 0, ((F.col("t") - start) * 1000).cast("string")))
    return rows.select("user_id", "event_id", F.to_json(F.struct(F.col("event_id").alias("sample"), F.col("t").cast("string").alias("source"), "timeline")).alias("line"))


@query("""WITH g AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey % 2 = 0), m AS (SELECT l_orderkey AS id, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1)
SELECT coalesce(g.id, m.id) AS id, CASE WHEN g.id IS NULL THEN 'no_group' WHEN m.id IS NULL THEN 'no_member' WHEN m.n <> m.d THEN 'repeated' ELSE 'ok' END AS status FROM g FULL JOIN m ON g.id = m.id""")
def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and members against each other: references both ways and members named once."""
    groups = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit(True).alias("g"))
    members = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d"))
    rules = [(F.col("g").isNull(), "no_group"), (F.col("n").isNull(), "no_member"), (F.col("n") != F.col("d"), "repeated")]
    return groups.join(members, "id", "full").select("id", decisions.decide(rules, "ok").alias("status"))


@query("SELECT source, count(*) AS n_files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes, count(*) FILTER (WHERE strlen(coalesce(text, '')) = 0) AS n_warnings FROM documents GROUP BY 1")
def extraction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_files"), F.sum(size.cast("long")).alias("n_bytes"), F.count(F.when(size == 0, 1)).alias("n_warnings"))


@query(f"WITH {_LOG}, f AS (SELECT user_id, event_id, t - 1500 - CAST(round(value * 10) AS BIGINT) // 2 AS centre FROM log WHERE event_type = 'view'), s AS (SELECT *, unnest(range(5)) AS row FROM f) SELECT user_id, event_id, row, centre + (row - 2) * 4000 AS at FROM s")
def readout_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre of each frame (clock, adjusted, less half the shutter) and the times of its read-out rows about it."""
    centre = F.col("t") - 1500 - F.expr("CAST(round(value * 10) AS BIGINT) div 2")
    rows = log(spark, sf_dir).where("event_type = 'view'").select("user_id", "event_id", centre.alias("centre"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("row"))
    return rows.select("user_id", "event_id", "row", (F.col("centre") + (F.col("row") - 2) * 4000).alias("at"))


@query(f"""WITH {_LOG}, r AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM log), f AS (SELECT user_id, min(t) + {_DAY} AS wanted FROM log GROUP BY 1), c AS (SELECT r.user_id, min(n) FILTER (WHERE r.t >= f.wanted AND n > 3) AS hit, max(n) AS last FROM r JOIN f USING (user_id) GROUP BY 1)
SELECT c.user_id, r.event_id, c.hit IS NULL AS at_end FROM c JOIN r ON r.user_id = c.user_id AND r.n = coalesce(c.hit, c.last)""")
def preview_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After three pairs, the first one not before a day from the start; the last one where none is: one aggregate, no sort kept."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = log(spark, sf_dir).select("user_id", "event_id", "t", F.row_number().over(order).alias("n"), F.min("t").over(Window.partitionBy("user_id")).alias("t0"))
    hit = (F.col("t") >= F.col("t0") + _DAY) & (F.col("n") > 3)
    found = rows.groupBy("user_id").agg(F.min_by("event_id", F.when(hit, F.col("n"))).alias("hit"), F.max_by("event_id", "n").alias("last"))
    return found.select("user_id", F.coalesce("hit", "last").alias("event_id"), F.col("hit").isNull().alias("at_end"))


@query(f"""WITH {_LOG}, s AS (SELECT user_id, t, event_id, coalesce(t - lag(t) OVER w > {7 * _DAY}, true) AS fresh FROM log WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM s)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, max(t) - min(t) AS span_us FROM g GROUP BY 1, 2""")
def qualified_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbroken stretches of samples and how long each is."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    fresh = F.coalesce(F.col("t") - F.lag("t").over(order) > 7 * _DAY, F.lit(True))
    rows = ordered.sessions(log(spark, sf_dir).withColumn("fresh", fresh), ["user_id"], ["t", "event_id"], F.col("fresh"), "run")
    return rows.groupBy("user_id", "run").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span_us"))


@query("SELECT source, doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN strlen(text) <> n THEN 'wrong_length' WHEN sha256(text) <> d THEN 'wrong_digest' ELSE 'ok' END AS status FROM (SELECT *, strlen(text) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN doc_id % 7 = 0 THEN '00' ELSE sha256(text) END AS d FROM documents)")
def verified_group_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.withColumn("n", F.octet_length("text") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).withColumn("d", F.when(F.col("doc_id") % 7 == 0, "00").otherwise(F.sha2(F.col("text").cast("binary"), 256)))
    return publish.verified(rows, "text", "n", "d").select("source", "doc_id", F.when(F.col("text").isNull(), "missing").otherwise(F.col("status")).alias("status"))
