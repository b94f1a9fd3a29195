"""Queries over motion, resized and sampled pictures, masks and calibrations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import colour, conversion, motion
from tidewell.functions import quaternion as quat
from tidewell.operators import frame_motion as frames
from tidewell.operators import raster, restoration, setups
from tidewell.plans.catalog import _DAY, _LOG, log, query, table
from tidewell.plans.rasters import _LISTS, lists
from tidewell.plans.scalars import _ITEM, _KEY, _Q, _RGB, bytes_of, item, poses, rounded

_MODE = "CASE vec_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'lock' ELSE 'follow' END"
#: Tiles as bytes, with the places of a resized picture of 5 x 5.
_SMALL = """t AS (SELECT vec_id, list_transform(embedding, lambda e: (CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT) % 256 + 256) % 256) AS t FROM embeddings), o AS (SELECT vec_id, t, unnest(range(25)) % 5 AS x, unnest(range(25)) // 5 AS y FROM t),
g AS (SELECT *, least(greatest(CAST(x + 0.5 AS DOUBLE) * CAST(1.6 AS DOUBLE) - 0.5, 0), 7) AS gx, least(greatest(CAST(y + 0.5 AS DOUBLE) * CAST(1.6 AS DOUBLE) - 0.5, 0), 7) AS gy FROM o),
k AS (SELECT *, CAST(floor(gx) AS BIGINT) AS x0, CAST(floor(gy) AS BIGINT) AS y0, CAST(round_even((1 - (gx - floor(gx))) * 2048, 0) AS BIGINT) AS a0, CAST(round_even((gx - floor(gx)) * 2048, 0) AS BIGINT) AS a1, CAST(round_even((1 - (gy - floor(gy))) * 2048, 0) AS BIGINT) AS b0, CAST(round_even((gy - floor(gy)) * 2048, 0) AS BIGINT) AS b1 FROM g),
r AS (SELECT *, t[y0 * 8 + x0 + 1] * a0 + t[y0 * 8 + least(x0 + 1, 7) + 1] * a1 AS upper, t[least(y0 + 1, 7) * 8 + x0 + 1] * a0 + t[least(y0 + 1, 7) * 8 + least(x0 + 1, 7) + 1] * a1 AS lower FROM k)"""
#: Masks of 8 x 8: a disc with holes.
_MASK = f"WITH {_LISTS}, m AS (SELECT vec_id, t, x, y, CASE WHEN (x - (3 + vec_id % 2)) * (x - (3 + vec_id % 2)) + (y - 4) * (y - 4) <= 16 AND t[y * 8 + x + 1] % 16 <> 0 THEN 1 ELSE 0 END AS m FROM p)"
#: A field of shifts over the tile, with its four taps about places that go over its ends.
_FIELD = f"""WITH {_LISTS}, s AS (SELECT vec_id, t, x, y, x * CAST(1.5 AS DOUBLE) - 2.25 - 8 * floor((x * CAST(1.5 AS DOUBLE) - 2.25) / 8) AS sx, y * CAST(1.25 AS DOUBLE) - 0.5 AS sy FROM p),
c AS (SELECT *, unnest([0, 1, 0, 1]) AS i, unnest([0, 0, 1, 1]) AS j FROM s), w AS (SELECT *, CAST(least(greatest(floor(sy) + j, 0), 7) * 8 + (floor(sx) + i) % 8 AS BIGINT) AS place, (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w FROM c),
v AS (SELECT vec_id, x, y, sy, w, t[place + 1] AS dx, t[64 - place] AS dy, abs(t[place + 1]) % 3 / CAST(2 AS DOUBLE) AS conf FROM w)"""


def steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, ("off", "lock", "follow"))), (F.col("vec_id") % 3 + 1).cast("int"))
    return poses(spark, sf_dir).withColumn("mode", mode)


@query(f"""WITH {_Q}, y AS (SELECT *, {_MODE} AS mode, atan2(2*(ax*az+aw*ay), 1-2*(ax*ax+ay*ay)) / 2 AS h FROM q), p AS (SELECT *, CASE WHEN mode = 'lock' THEN cw ELSE cos(h) END AS pw, CASE WHEN mode = 'lock' THEN cx ELSE 0 END AS px, CASE WHEN mode = 'lock' THEN cy ELSE sin(h) END AS py, CASE WHEN mode = 'lock' THEN cz ELSE 0 END AS pz FROM y)
SELECT vec_id, CASE WHEN mode = 'off' THEN 1.0 ELSE round(pw*aw+px*ax+py*ay+pz*az, 6) END AS w, CASE WHEN mode = 'off' THEN 0.0 ELSE round(-pw*ax+px*aw-py*az+pz*ay, 6) END AS x, CASE WHEN mode = 'off' THEN 0.0 ELSE round(-pw*ay+px*az+py*aw-pz*ax, 6) END AS y, CASE WHEN mode = 'off' THEN 0.0 ELSE round(-pw*az-px*ay+py*ax+pz*aw, 6) END AS z FROM p""")
def steady_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(steady(spark, sf_dir).select("vec_id", motion.correction(F.col("mode"), F.col("a"), F.col("b")).alias("q")), ["vec_id"], "q", "wxyz")


@query(f"""WITH {_Q}, m AS (SELECT *, {_MODE} AS mode, abs(e[12]) / 2 AS h FROM q) SELECT vec_id, CASE mode WHEN 'off' THEN round(aw, 6) WHEN 'lock' THEN 1.0 ELSE round(cos(h), 6) END AS w, CASE mode WHEN 'off' THEN round(ax, 6) ELSE 0.0 END AS x, CASE mode WHEN 'off' THEN round(ay, 6) ELSE 0.0 END AS y, CASE mode WHEN 'off' THEN round(az, 6) WHEN 'lock' THEN 0.0 ELSE round(sin(h), 6) END AS z FROM m""")
def target_attitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(steady(spark, sf_dir).select("vec_id", motion.target(F.col("mode"), F.col("a"), F.col("amount")).alias("q")), ["vec_id"], "q", "wxyz")


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST((vec_id % 640 + 0.5) / 640 AS DOUBLE) AS x, CAST((vec_id % 480 + 0.5) / 480 AS DOUBLE) AS y FROM embeddings), f AS (SELECT *, CASE vec_id % 4 WHEN 0 THEN 0.1 + y * CAST(0.8 AS DOUBLE) WHEN 1 THEN 1 - (0.1 + y * CAST(0.8 AS DOUBLE)) WHEN 2 THEN 0.1 + x * CAST(0.8 AS DOUBLE) ELSE 1 - (0.1 + x * CAST(0.8 AS DOUBLE)) END * 15 AS f FROM p),
a AS (SELECT vec_id, f - least(floor(f), 14) AS t, e[CAST(least(floor(f), 14) * 4 + 1 AS BIGINT):CAST(least(floor(f), 14) * 4 + 8 AS BIGINT)] AS e FROM f), n AS (SELECT *, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) AS na, sqrt(e[5]*e[5]+e[6]*e[6]+e[7]*e[7]+e[8]*e[8]) AS nb FROM a),
d AS (SELECT *, (e[1]*e[5]+e[2]*e[6]+e[3]*e[7]+e[4]*e[8])/na/nb AS dot FROM n), g AS (SELECT *, CASE WHEN dot < 0 THEN -1.0 ELSE 1.0 END AS s, acos(least(abs(dot), 1)) AS th, abs(dot) > 0.9995 AS near FROM d), k AS (SELECT *, CASE WHEN near THEN 1 - t ELSE sin((1-t)*th)/sin(th) END / na AS u, s * CASE WHEN near THEN t ELSE sin(t*th)/sin(th) END / nb AS v FROM g),
m AS (SELECT vec_id, e[1]*u+e[5]*v AS w, e[2]*u+e[6]*v AS x, e[3]*u+e[7]*v AS y, e[4]*u+e[8]*v AS z FROM k), l AS (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS n FROM m) SELECT vec_id, round(w/n, 6) AS w, round(x/n, 6) AS x, round(y/n, 6) AS y, round(z/n, 6) AS z FROM l""")
def readout_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen poses of a row as the read-out table of a frame, each looked up at one of its pixels."""
    at = lambda i: F.get("embedding", i).cast("double")
    of = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: quat.norm(quat.quaternion(*[at(i * 4 + k) for k in range(4)])))
    direction = F.element_at(F.array(*map(F.lit, motion.DIRECTIONS)), (F.col("vec_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", of.alias("poses"), direction.alias("direction"))
    pose = motion.readout_pose(F.col("poses"), F.col("direction"), F.col("vec_id") % 640, F.col("vec_id") % 480, F.lit(640), F.lit(480), F.lit(0.1), F.lit(0.1) + F.lit(0.8))
    return rounded(rows.select("vec_id", pose.alias("q")), ["vec_id"], "q", "wxyz")


@query(f"""WITH {_LOG}, p AS (SELECT user_id, t, max(value) AS h FROM log WHERE event_type = 'click' GROUP BY 1, 2), f AS (SELECT user_id, event_id, t, t + event_id % 3 * 1000000 AS t1 FROM log WHERE event_type = 'view'),
l AS (SELECT user_id, event_id, unnest([-1, 0, 0, 0, 1, 1, 1]) AS lens, unnest([1, 0, 1, 2, 0, 1, 2]) AS i, t AS c0, t1 AS c1 FROM f), m AS (SELECT user_id, event_id, lens, i, CASE WHEN lens = 1 THEN c1 ELSE c0 END + (i - 1) * 3600000000 AS t FROM l),
a AS (SELECT m.*, p.t AS t0, p.h AS h0 FROM m ASOF LEFT JOIN p ON m.user_id = p.user_id AND m.t >= p.t), b AS (SELECT a.*, p.t AS t1, p.h AS h1 FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.t <= p.t),
k AS (SELECT *, radians(h0 % 180) / 2 AS q0, radians(h1 % 180) / 2 AS q1, CASE WHEN t1 = t0 THEN 0 ELSE (t - t0) / CAST(t1 - t0 AS DOUBLE) END AS k FROM b), q AS (SELECT *, q0 + (q1 - q0) * k AS q FROM k), r AS (SELECT *, max(q) FILTER (WHERE lens = -1) OVER (PARTITION BY user_id, event_id) AS ref, bool_or(t0 IS NULL OR t1 IS NULL) OVER (PARTITION BY user_id, event_id) AS bad FROM q)
SELECT user_id, event_id, lens, i, round(cos(ref - q), 3) AS w, round(sin(ref - q), 3) AS y, round(cos(ref), 3) AS cw, round(sin(ref), 3) AS cy FROM r WHERE NOT bad AND lens >= 0""")
def frame_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-out poses of both lenses about each frame, and the turn that levels it; turns about one axis, so the SQL adds angles."""
    rows = log(spark, sf_dir)
    half = F.radians(F.col("value") % 180) / 2
    track = rows.where("event_type = 'click'").groupBy("user_id", "t").agg(F.max("value").alias("value")).select("user_id", "t", quat.quaternion(F.cos(half), F.lit(0), F.sin(half), F.lit(0)).alias("pose"), F.lit(0.0).alias("heading"))
    shown = rows.where("event_type = 'view'").select("user_id", "event_id", F.array("t", F.col("t") + F.col("event_id") % 3 * 1_000_000).alias("centres"), F.lit(7200.0).alias("seconds"), F.lit("lock").alias("mode"))
    found = frames.frame_motion(shown, track, ["user_id"], ["event_id"], "t", _DAY, n_poses=3).where("error IS NULL")
    one = found.select("user_id", "event_id", "correction", F.posexplode("tables").alias("lens", "table"))
    one = one.select("user_id", "event_id", "correction", "lens", F.posexplode("table").alias("i", "q"))
    return one.select("user_id", "event_id", "lens", "i", F.round("q.w", 3).alias("w"), F.round("q.y", 3).alias("y"), F.round("correction.w", 3).alias("cw"), F.round("correction.y", 3).alias("cy"))


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.pmod(F.floor(e.cast("double") * 256), F.lit(256))).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"))
    return rows.select("vec_id", "t", (F.col("i") % 5).cast("long").alias("x"), F.floor(F.col("i") / 5).alias("y"))


@query(f"WITH {_SMALL} SELECT vec_id, x, y, CAST((((b0 * (upper >> 4)) >> 16) + ((b1 * (lower >> 4)) >> 16) + 2) >> 2 AS INTEGER) AS v FROM r")
def resize_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(spark, sf_dir).select("vec_id", "x", "y", raster.resize_stepwise(F.col("t"), F.col("x"), F.col("y"), (8, 8), (5, 5)).alias("v"))


@query(f"WITH {_SMALL} SELECT vec_id, x, y, CAST(least(greatest((upper * b0 + lower * b1 + 2097152) >> 22, 0), 255) AS INTEGER) AS v FROM r")
def resize_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(spark, sf_dir).select("vec_id", "x", "y", raster.resize_at_once(F.col("t"), F.col("x"), F.col("y"), (8, 8), (5, 5)).alias("v"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, t, m): tiles with masks."""
    tile = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * 256)).alias("t"))
    inside = lambda v, i: raster.in_disc(i % 8, F.floor(i / 8), 3 + F.col("vec_id") % 2, F.lit(4), F.lit(4)) & (v % 16 != 0)
    return tile.withColumn("m", F.transform("t", lambda v, i: inside(v, i).cast("int")))


def placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("x", (F.col("i") % 8).cast("long")).withColumn("y", F.floor(F.col("i") / 8))


@query(f"""{_MASK}, z AS (SELECT vec_id, x AS zx, y AS zy FROM m WHERE m = 0), d AS (SELECT m.vec_id, m.x, m.y, greatest(abs(x - zx), abs(y - zy)) AS hi, least(abs(x - zx), abs(y - zy)) AS lo FROM m LEFT JOIN z ON m.vec_id = z.vec_id),
c AS (SELECT vec_id, x, y, min(CASE WHEN hi >= 2 * lo THEN (hi - 2 * lo) * 65536 + lo * 143976 ELSE (hi - lo) * 143976 + (2 * lo - hi) * 91750 END) AS c FROM d GROUP BY 1, 2, 3) SELECT vec_id, x, y, round(least(coalesce(c, 4294967296) / CAST(65536 AS DOUBLE) * CAST(0.3 AS DOUBLE), 1), 6) AS weight FROM c""")
def mask_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that grow from a mask's zeros; the SQL compares every pixel with every zero."""
    rows = raster.feather(masks(spark, sf_dir).select("vec_id", "m"), "m", 8, 8, 0.3)
    return placed(rows.select("vec_id", "weights")).select("vec_id", "x", "y", F.round(F.get("weights", F.col("i")), 6).alias("weight"))


@query(f"""{_MASK}, c AS (SELECT a.vec_id, a.x, a.y, unnest([0, 1, 0, 1]) AS i, unnest([0, 0, 1, 1]) AS j FROM m a), w AS (SELECT c.*, CASE WHEN i = 1 THEN CASE WHEN c.x = 7 THEN 0 ELSE 0.25 END ELSE CASE WHEN c.x = 7 THEN 1 ELSE 0.75 END END * CASE WHEN j = 1 THEN CASE WHEN c.y = 7 THEN 0 ELSE 0.75 END ELSE CASE WHEN c.y = 7 THEN 1 ELSE 0.25 END END AS w FROM c),
v AS (SELECT w.vec_id, w.x, w.y, CAST(w.w AS DOUBLE) AS w, m.m, m.t[m.y * 8 + m.x + 1] AS v FROM w JOIN m ON m.vec_id = w.vec_id AND m.x = least(w.x + i, 7) AND m.y = least(w.y + j, 7)) SELECT vec_id, x, y, round(CASE WHEN sum(w * m) > 0 THEN sum(w * m * v) / sum(w * m) ELSE 0 END, 6) AS v, round(sum(w * m), 6) AS weight FROM v GROUP BY 1, 2, 3""")
def masked_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(masks(spark, sf_dir)).withColumns({"px": F.least(F.col("x") + 0.25, F.lit(7.0)), "py": F.least(F.col("y") + 0.75, F.lit(7.0))})
    at = (F.col("px"), F.col("py"), 8, 8)
    return rows.select("vec_id", "x", "y", F.round(raster.masked_bilinear(F.col("t"), F.col("m"), *at), 6).alias("v"), F.round(raster.mask_weight(F.col("m"), *at), 6).alias("weight"))


@query(f"""{_FIELD} SELECT vec_id, x, y, CASE WHEN any_value(sy) BETWEEN 0 AND 7 THEN round(sum(w * conf), 6) ELSE 0 END AS conf, CASE WHEN any_value(sy) BETWEEN 0 AND 7 AND sum(w * conf) > 0 THEN round(sum(w * conf * dx) / sum(w * conf), 6) ELSE 0 END AS dx, CASE WHEN any_value(sy) BETWEEN 0 AND 7 THEN round(sum(w * dy), 6) ELSE 0 END AS dy,
CASE WHEN any_value(sy) BETWEEN 0 AND 7 AND bool_and(w <= 0 OR conf > 0) THEN round(sum(w * dx), 6) END AS v FROM v GROUP BY 1, 2, 3""")
def field_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of shifts by trusted taps, by plain shares, and as a picture with invalid places, around its ends."""
    trust = F.transform("t", lambda v: F.abs(v) % 3 / 2.0)
    rows = lists(spark, sf_dir).withColumns({"u": F.reverse("t"), "c": trust, "sx": F.col("x") * 1.5 - 2.25, "sy": F.col("y") * 1.25 - 0.5})
    at = (F.col("sx"), F.col("sy"), 8, 8)
    rows = rows.withColumn("trusted", raster.field_sample(F.col("t"), F.col("u"), F.col("c"), *at)).withColumn("plain", raster.displacement_sample(F.col("t"), F.col("u"), *at))
    picture = raster.wrapped_sample(F.col("t"), F.transform("c", lambda v: v > 0), *at)
    return rows.select("vec_id", "x", "y", F.round("trusted.confidence", 6).alias("conf"), F.round("trusted.dx", 6).alias("dx"), F.round("plain.dy", 6).alias("dy"), F.round(picture, 6).alias("v"))


@query(f"WITH {_LISTS} SELECT vec_id, avg(CASE WHEN abs(t[y * 8 + x + 1]) % 3 >= 1 THEN 1.0 ELSE 0.0 END) AS coverage FROM p GROUP BY 1")
def seam_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lists(spark, sf_dir).select("vec_id", (F.abs(F.get("t", (F.col("y") * 8 + F.col("x")).cast("int"))) % 3 / 2).alias("c"))
    return raster.coverage(rows, ["vec_id"], "c")


@query(f"""WITH g AS (SELECT {_ITEM}, CASE WHEN l_linenumber = 7 THEN 5313 ELSE 5312 END AS cw, 2656 AS ch, CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 6 END AS ver, l_linenumber % 3 * 1328 + 1328 AS sw, l_linenumber % 3 * 1328 + 1328 + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS sh, CASE WHEN l_partkey % 5 = 0 THEN 2656 ELSE 1000 + l_partkey % 300 END AS dw, CASE WHEN l_partkey % 5 = 0 THEN 2656 ELSE 900 + l_partkey % 200 END AS dh, l_orderkey % 21 - 10 AS ox, l_orderkey % 11 - 5 AS oy, l_linenumber = 6 AS nocrop FROM lineitem),
d AS (SELECT *, NOT nocrop AND (sw = dw AND sh = dh) AS whole FROM g), n AS (SELECT *, nocrop OR (whole AND ox = 0 AND oy = 0) AS none FROM d), f AS (SELECT *, none OR (cw % 2 = 0 AND cw // 2 = dw AND ch = dh AND NOT whole) AS done FROM n), e AS (SELECT *, CASE WHEN NOT none AND cw % 2 <> 0 THEN 'odd_canvas' WHEN NOT done AND cw // 2 * sh <> ch * sw THEN 'aspect' WHEN NOT done AND ver = 1 THEN 'version' END AS error, sw / CAST(cw // 2 AS DOUBLE) AS s FROM f)
SELECT {_ITEM}, error, CASE WHEN error IS NULL THEN NOT done END AS changed, CASE WHEN error IS NULL THEN round(CASE WHEN done THEN 900.0 ELSE 900 * s END, 6) END AS fx, CASE WHEN error IS NULL THEN round(CASE WHEN done THEN 3990.5 ELSE (3990.5 - 2656 + 0.5) * s - 0.5 - ((sw - dw) / CAST(2 AS DOUBLE) + ox) + dw END, 6) END AS cx, CASE WHEN error IS NULL THEN round(CASE WHEN done THEN 1330.25 ELSE (1330.25 + 0.5) * s - 0.5 - ((sh - dh) / CAST(2 AS DOUBLE) + oy) END, 6) END AS cy FROM e""")
def crop_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second lens of a calibration carried over to a sensor crop."""
    part, order, line, own = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey") % 5 == 0
    side = line % 3 * 1328 + 1328
    crop = F.struct(side.alias("sw"), (side + (F.col("l_suppkey") % 7 == 0).cast("int")).alias("sh"), F.when(own, 2656).otherwise(1000 + part % 300).alias("dw"), F.when(own, 2656).otherwise(900 + part % 200).alias("dh"), (order % 21 - 10).alias("x"), (order % 11 - 5).alias("y"))
    lens = lambda cx: F.struct(*[F.lit(v).alias(n) for n, v in (("fx", 900.0), ("fy", 900.0), ("cx", cx), ("cy", 1330.25))])
    found = conversion.cropped(F.array(lens(1320.5), lens(3990.5)), F.when(line == 7, 5313).otherwise(5312), F.lit(2656), F.when(F.col("l_suppkey") % 9 == 0, 1).otherwise(6), F.when(line != 6, crop))
    rows = item(spark, sf_dir).select(*_KEY, found.alias("r")).withColumn("lens", F.get("r.lenses", 1))
    return rows.select(*_KEY, "r.error", "r.changed", *[F.round(f"lens.{c}", 6).alias(c) for c in ("fx", "cx", "cy")])


@query("""WITH g AS (SELECT s_suppkey, 1 + s_nationkey / CAST(25 AS DOUBLE) AS xi, CAST(800 + s_suppkey % 50 AS DOUBLE) AS f, CAST(180 + s_suppkey % 20 AS DOUBLE) AS fov FROM supplier), a AS (SELECT *, unnest(range(CAST(ceil(fov * CAST(0.5 AS DOUBLE) / CAST(0.1 AS DOUBLE)) AS BIGINT))) * CAST(0.1 AS DOUBLE) AS d FROM g),
u AS (SELECT *, sin(radians(d)) / (cos(radians(d)) + xi) AS u, 0.05 * d - 0.00001 * d * d * d AS p FROM a), q AS (SELECT *, f * (u + 0.1 * u^3 - 0.02 * u^5 + 0.003 * u^7) AS q FROM u), s AS (SELECT s_suppkey, sum(p * q) / sum(p * p) AS s FROM q GROUP BY 1), e AS (SELECT s_suppkey, 1 / (xi + cos(pi() / 2)) AS u, f FROM g)
SELECT s_suppkey, CASE WHEN s > 0 THEN round(s, 5) END AS scale, CASE WHEN f * (u + 0.1 * u^3 - 0.02 * u^5 + 0.003 * u^7) / (4.5 - 7.29) > 0 THEN round(f * (u + 0.1 * u^3 - 0.02 * u^5 + 0.003 * u^7) / (4.5 - 7.29), 5) END AS edge FROM s JOIN e USING (s_suppkey)""")
def physical_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = F.array(*map(F.lit, (0.0, 0.05, 0.0, -0.00001)))
    lens = (1 + F.col("s_nationkey") / 25.0, (800 + F.col("s_suppkey") % 50).cast("double"), F.array(*map(F.lit, (0.1, -0.02, 0.003, 0.0, 0.0))), curve)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(conversion.physical_scale(*lens, (180 + F.col("s_suppkey") % 20).cast("double")), 5).alias("scale"), F.round(conversion.physical_scale_at_edge(*lens), 5).alias("edge"))


_LENSES = "r AS (SELECT 'c' || (p_partkey // 500) AS camera, p_partkey % 500 AS lens_id, p_size % 2 AS optics, p_partkey % 3 AS mask FROM part), s AS (SELECT lens_id, any_value(optics) AS optics, any_value(mask) AS mask FROM r GROUP BY 1 HAVING count(DISTINCT optics * 10 + mask) = 1)"


def lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.floor(part / 500).cast("string")).alias("camera"), (part % 500).alias("lens_id"), (F.col("p_size") % 2).alias("optics"), (part % 3).alias("mask"))


@query(f"WITH {_LENSES} SELECT lens_id, optics FROM (SELECT lens_id, any_value(optics) AS optics FROM r GROUP BY 1 HAVING count(DISTINCT optics) = 1)")
def lens_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setups.agreed(lenses(spark, sf_dir), ["optics"])


@query(f"WITH {_LENSES}, l AS (SELECT {_ITEM}, CASE WHEN l_linenumber > 1 THEN 'c' || (l_suppkey % 6) END AS camera, l_partkey % 500 AS lens_id FROM lineitem) SELECT {_ITEM}, l.camera, l.lens_id, coalesce(r.optics, CASE WHEN l.camera IS NULL THEN s.optics END) AS optics, coalesce(r.mask, CASE WHEN l.camera IS NULL THEN s.mask END) AS mask FROM l LEFT JOIN r ON r.camera = l.camera AND r.lens_id = l.lens_id LEFT JOIN s ON s.lens_id = l.lens_id")
def resolved_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item(spark, sf_dir).select(*_KEY, F.when(F.col("l_linenumber") > 1, F.concat(F.lit("c"), (F.col("l_suppkey") % 6).cast("string"))).alias("camera"), (F.col("l_partkey") % 500).alias("lens_id"))
    return setups.resolved_lens(rows, lenses(spark, sf_dir), ["optics", "mask"])


@query("""WITH m AS (SELECT o_orderkey, o_custkey % 3 AS a, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey % 3 END AS b, CASE WHEN o_custkey % 3 > 0 THEN 'e' || (o_custkey % 3) END AS e, CASE o_orderkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'e1' ELSE 'e2' END AS r, CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 6 END AS v, o_orderpriority <> '2-HIGH' AS omni FROM orders)
SELECT o_orderkey, CASE WHEN a <> b THEN 'lens_types' WHEN r = 'auto' THEN CASE WHEN e IS NOT NULL THEN 'keep' ELSE 'unmapped' END WHEN e = r THEN 'keep' WHEN v <> 6 OR NOT omni THEN 'version' WHEN a = 0 THEN 'source_curve' WHEN r = 'e2' THEN 'target_curve' ELSE 'convert' END AS step FROM m""")
def setup_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a requested optical setup asks of a calibration."""
    kind, order = F.col("o_custkey") % 3, F.col("o_orderkey")
    requested = F.when(order % 3 == 0, "auto").when(order % 3 == 1, "e1").otherwise("e2")
    step = setups.setup_step(kind, F.when(F.col("o_orderstatus") == "P", -1).otherwise(kind), F.when(kind > 0, F.concat(F.lit("e"), kind.cast("string"))), requested, F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(6), F.col("o_orderpriority") != "2-HIGH", F.when(kind > 0, 1), F.when(requested == "e1", 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", step.alias("step"))


@query(f"WITH {_LOG}, p AS (SELECT event_id, t // 1000000 AS pts, CASE WHEN event_id % 10 = 0 THEN t // 1000000 + 1 ELSE event_id % 1000 END AS s, event_id % 7 * 143 AS n FROM log) SELECT event_id, CASE WHEN pts >= s AND n > 0 THEN CAST(CAST(pts - s AS HUGEINT) * n * 1000000000 // 30000 AS BIGINT) END AS nanos FROM p")
def stream_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = F.expr("t div 1000000")
    start = F.when(F.col("event_id") % 10 == 0, pts + 1).otherwise(F.col("event_id") % 1000)
    return log(spark, sf_dir).select("event_id", motion.elapsed(pts, start, F.col("event_id") % 7 * 143, F.lit(30000)).cast("long").alias("nanos"))


@query("SELECT vec_id, round(CAST(embedding[10] AS DOUBLE), 6) AS x, round(CAST(embedding[11] AS DOUBLE), 6) AS y, round(CAST(embedding[9] AS DOUBLE), 6) AS z FROM embeddings")
def body_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(poses(spark, sf_dir).select("vec_id", motion.body_axes(F.col("v")).alias("b")), ["vec_id"], "b", "xyz")


@query(f"WITH {_RGB} SELECT {_ITEM}, round(r / (255 * CAST(0.229 AS DOUBLE)) - CAST(0.485 AS DOUBLE) / 0.229, 6) AS r, round(g / (255 * CAST(0.224 AS DOUBLE)) - CAST(0.456 AS DOUBLE) / 0.224, 6) AS g, round(b / (255 * CAST(0.225 AS DOUBLE)) - CAST(0.406 AS DOUBLE) / 0.225, 6) AS b FROM rgb")
def network_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bytes_of(spark, sf_dir).select(*_KEY, colour.network_input(F.col("r"), F.col("g"), F.col("b")).alias("p")), _KEY, "p", "rgb")


@query()
def restore_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as the frames of sixteen recordings, restored in order; no SQL, as a frame's state comes from those before it."""
    byte = lambda c: F.lpad(F.hex(F.pmod(F.floor(c.cast("double") * 256), F.lit(256))), 2, "0")
    rgb = F.unhex(F.array_join(F.transform("embedding", lambda e: F.concat(byte(e), byte(e * 3), byte(e * 5))), ""))
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 16).alias("recording"), "vec_id", F.col("vec_id").cast("double").alias("t"), rgb.alias("rgb"))
    return restoration.restored(rows, ["recording"], "vec_id", "t", "rgb", 8, 8).select("recording", "vec_id", F.crc32("rgb").alias("crc"), F.length("rgb").cast("long").alias("n_bytes"))
