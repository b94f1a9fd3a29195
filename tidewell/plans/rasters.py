"""Queries over pictures: 8 x 8 tiles as arrays or pixels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import raster
from tidewell.plans.catalog import _TILES, query, table, tiles

#: Tiles as integer lists, with each of their places.
_LISTS = "t AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS t FROM embeddings), p AS (SELECT vec_id, t, unnest(range(64)) % 8 AS x, unnest(range(64)) // 8 AS y FROM t)"


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, t array<long>, x, y): each place beside its whole tile, so that taps need no join."""
    tile = F.transform("embedding", lambda e: F.floor(e.cast("double") * 256))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", tile.alias("t"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return rows.select("vec_id", "t", (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"))


def _tap(dx: object, dy: object) -> str:
    return f"t[least(greatest(y + ({dy}), 0), 7) * 8 + least(greatest(x + ({dx}), 0), 7) + 1]"


@query(f"WITH {_LISTS}, k AS (SELECT *, CASE WHEN x = 7 THEN 0 ELSE 0.25 END AS fx, CASE WHEN y = 7 THEN 0 ELSE 0.75 END AS fy FROM p) SELECT vec_id, x, y, round(({_tap(0, 0)} * (1-fx) + {_tap(1, 0)} * fx) * (1-fy) + ({_tap(0, 1)} * (1-fx) + {_tap(1, 1)} * fx) * fy, 6) AS v FROM k")
def bilinear_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).select("vec_id", "x", "y", F.round(raster.bilinear(F.col("t"), F.col("x") + 0.25, F.col("y") + 0.75, 8, 8), 6).alias("v"))


_LOW = " + ".join(f"{a * b} * {_tap(i - 2, j - 2)}" for i, a in enumerate((1, 4, 6, 4, 1)) for j, b in enumerate((1, 4, 6, 4, 1)))


@query(f"WITH {_LISTS} SELECT vec_id, x, y, round(({_LOW}) / CAST(256 AS DOUBLE), 6) AS low, round({_tap(0, 0)} - ({_LOW}) / CAST(256 AS DOUBLE), 6) AS high FROM p")
def lowpass_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two bands of a picture: a smooth one and what is left."""
    rows = lists(spark, sf_dir).withColumn("v", raster.pixel(F.col("t"), F.col("x"), F.col("y"), 8, 8)).withColumn("l", raster.low_pass(F.col("t"), F.col("x"), F.col("y"), 8, 8))
    return rows.select("vec_id", "x", "y", F.round("l", 6).alias("low"), F.round(F.col("v") - F.col("l"), 6).alias("high"))


@query(f"WITH {_LISTS} SELECT vec_id, x, y, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN ({_tap(1, 0)} - {_tap(-1, 0)}) / CAST(2 AS DOUBLE) END AS gx, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN ({_tap(0, 1)} - {_tap(0, -1)}) / CAST(2 AS DOUBLE) END AS gy FROM p")
def image_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central differences; null where a neighbour is missing."""
    tap = lambda dx, dy: raster.pixel(F.col("t"), F.col("x") + dx, F.col("y") + dy, 8, 8)
    inner = F.col("x").between(1, 6) & F.col("y").between(1, 6)
    return lists(spark, sf_dir).select("vec_id", "x", "y", F.when(inner, (tap(1, 0) - tap(-1, 0)) / 2.0).alias("gx"), F.when(inner, (tap(0, 1) - tap(0, -1)) / 2.0).alias("gy"))


@query(f"WITH {_LISTS}, d AS (SELECT vec_id, (1 + ({_tap(1, 0)} - {_tap(0, 0)}) / CAST(512 AS DOUBLE)) * (1 + ({_tap(0, 1)} - {_tap(0, 0)}) / CAST(512 AS DOUBLE)) - ({_tap(1, 1)} - {_tap(1, 0)}) * ({_tap(1, 1)} - {_tap(0, 1)}) / CAST(262144 AS DOUBLE) AS d FROM p WHERE x < 7 AND y < 7) SELECT vec_id, round(min(d), 6) AS least, count(*) FILTER (WHERE d < 0.25) AS n_folded FROM d GROUP BY 1")
def jacobian_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least determinant of each displacement field over its cells, and how many cells fold."""
    tap = lambda dx, dy: raster.pixel(F.col("t"), F.col("x") + dx, F.col("y") + dy, 8, 8)
    d = (1 + (tap(1, 0) - tap(0, 0)) / 512.0) * (1 + (tap(0, 1) - tap(0, 0)) / 512.0) - (tap(1, 1) - tap(1, 0)) * (tap(1, 1) - tap(0, 1)) / 262144.0
    cells = lists(spark, sf_dir).where("x < 7 AND y < 7").select("vec_id", d.alias("d"))
    return cells.groupBy("vec_id").agg(F.round(F.min("d"), 6).alias("least"), F.count(F.when(F.col("d") < 0.25, 1)).alias("n_folded"))


def _mirrored(name: str, source: str, columns: str) -> str:
    """SQL of a 3 x 3 mirrored mean of columns over tiles of 4 x 4."""
    near = "o AS (SELECT a - 1 AS dx, b - 1 AS dy FROM range(3) u(a), range(3) v(b))"
    cells = f"SELECT vec_id, x, y, CASE WHEN x + dx < 0 THEN 1 WHEN x + dx > 3 THEN 2 ELSE x + dx END AS sx, CASE WHEN y + dy < 0 THEN 1 WHEN y + dy > 3 THEN 2 ELSE y + dy END AS sy FROM {source}, ({near[6:-1]})"
    means = ", ".join(f"avg(s.{c}) AS {c}" for c in columns.split())
    return f"{name} AS (SELECT w.vec_id, w.x, w.y, {means} FROM ({cells}) w JOIN {source} s ON s.vec_id = w.vec_id AND s.x = w.sx AND s.y = w.sy GROUP BY 1, 2, 3)"


@query(f"""WITH {_TILES}, h AS (SELECT vec_id, x // 2 AS x, y // 2 AS y, CAST(v AS DOUBLE) AS g, CAST((v * 7) % 256 AS DOUBLE) AS s FROM tiles WHERE x % 2 = 0 AND y % 2 = 0), q AS (SELECT vec_id, x, y, g AS mg, s AS ms, g*g AS gg, g*s AS gs FROM h), {_mirrored('m', 'q', 'mg ms gg gs')},
l AS (SELECT vec_id, x, y, (gs - mg*ms) / (gg - mg*mg + 650.25) AS a, ms - (gs - mg*ms) / (gg - mg*mg + 650.25) * mg AS b FROM m), {_mirrored('r', 'l', 'a b')} SELECT vec_id, x, y, round(a, 5) AS a, round(b, 4) AS b FROM r""")
def guided_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each half-size picture: every second pixel, local moments, smoothed coefficients."""
    half = tiles(spark, sf_dir).where("x % 2 = 0 AND y % 2 = 0").select("vec_id", F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y"), F.col("v").cast("double").alias("g"), (F.col("v") * 7 % 256).cast("double").alias("s"))
    return raster.guided_coefficients(half, ["vec_id"], "g", "s", 4, 4, 1, 650.25).select("vec_id", "x", "y", F.round("a", 5).alias("a"), F.round("b", 4).alias("b"))


@query(f"WITH {_TILES}, c AS (SELECT vec_id, x, y, abs(v) % 256 AS r, abs(v * 3) % 256 AS g, abs(v * 5) % 256 AS b FROM tiles) SELECT vec_id, x // 2 AS x, y // 2 AS y, CAST(sum(CAST(floor(16 + 219 * (0.2126*r + 0.7152*g + 0.0722*b) / 255 + 0.5) AS BIGINT)) AS BIGINT) AS luma, CAST(floor(128 + 224 * (avg(b) - (0.2126*avg(r) + 0.7152*avg(g) + 0.0722*avg(b))) / 1.8556 / 255 + 0.5001) AS BIGINT) AS cb, CAST(floor(128 + 224 * (avg(r) - (0.2126*avg(r) + 0.7152*avg(g) + 0.0722*avg(b))) / 1.5748 / 255 + 0.5001) AS BIGINT) AS cr FROM c GROUP BY vec_id, x // 2, y // 2")
def rgb_yuv420(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limited-range luma of four pixels and the chroma of their mean."""
    byte = lambda k: F.abs(F.col("v") * k) % 256
    rows = tiles(spark, sf_dir).select("vec_id", F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y"), byte(1).alias("r"), byte(3).alias("g"), byte(5).alias("b"))
    grey = lambda r, g, b: 0.2126 * r + 0.7152 * g + 0.0722 * b
    luma = F.sum(F.floor(16 + 219 * grey(F.col("r"), F.col("g"), F.col("b")) / 255 + 0.5))
    means = rows.groupBy("vec_id", "x", "y").agg(luma.alias("luma"), *[F.avg(c).alias(c) for c in "rgb"])
    chroma = lambda c, full: F.floor(128 + 224 * (F.col(c) - grey(F.col("r"), F.col("g"), F.col("b"))) / full / 255 + 0.5001)
    return means.select("vec_id", "x", "y", "luma", chroma("b", 1.8556).alias("cb"), chroma("r", 1.5748).alias("cr"))


@query("""WITH m AS (SELECT *, l_partkey % 41 - 20 AS dx, l_orderkey % 41 - 20 AS dy, l_suppkey % 7 AS trip, l_quantity AS variance FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, (dx*dx + dy*dy <= 256 AND trip <= 3 AND 1 - l_discount >= 0.95 AND variance >= 9 AND l_tax * 400 <= greatest(0.95 * l_discount * 500, 18)) AS kept FROM m""")
def proposal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed displacements that are short, come back, are covered, have texture and do not fit worse."""
    dx, dy = F.col("l_partkey") % 41 - 20, F.col("l_orderkey") % 41 - 20
    kept = (dx * dx + dy * dy <= 256) & (F.col("l_suppkey") % 7 <= 3) & (1 - F.col("l_discount") >= 0.95) & (F.col("l_quantity") >= 9) & (F.col("l_tax") * 400 <= F.greatest(0.95 * F.col("l_discount") * 500, F.lit(18.0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kept.alias("kept"))


@query("""WITH g AS (SELECT l_orderkey, avg(((9798 * (l_partkey % 256) + 19235 * (l_orderkey % 256) + 3735 * (l_suppkey % 256) + 16384) >> 15) / CAST(255 AS DOUBLE)) AS mean FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(mean, 6) AS mean, CASE WHEN mean > 0 AND mean < 1 THEN round(ln(least(1.5 * mean, 0.55)) / ln(mean), 6) END AS gamma FROM g""")
def brighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean grey of each picture and the exponent that takes it to its target; none where the mean is 0 or 1."""
    from tidewell.functions import optics

    byte = lambda c: F.col(c) % 256
    mean = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg(optics.grey(byte("l_partkey"), byte("l_orderkey"), byte("l_suppkey")) / 255).alias("mean"))
    gamma = F.when((F.col("mean") > 0) & (F.col("mean") < 1), F.log(F.least(1.5 * F.col("mean"), F.lit(0.55))) / F.log("mean"))
    return mean.select("l_orderkey", F.round("mean", 6).alias("mean"), F.round(gamma, 6).alias("gamma"))


@query(f"""WITH {_TILES}, f AS (SELECT vec_id, x, y, CAST(v % 3 AS BIGINT) AS d FROM tiles WHERE vec_id % 2 = 0), b AS (SELECT vec_id - 1 AS vec_id, x, y, CAST(v % 3 AS BIGINT) AS d FROM tiles WHERE vec_id % 2 = 1)
SELECT f.vec_id, f.x, f.y, abs(f.d + b.d) AS residual FROM f JOIN b ON b.vec_id = f.vec_id AND b.y = f.y AND b.x = f.x + f.d WHERE abs(f.d + b.d) <= 1""")
def flow_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward displacements that the backward ones at their ends undo."""
    rows = tiles(spark, sf_dir).withColumn("d", F.col("v") % 3)
    ahead = rows.where("vec_id % 2 = 0").withColumn("tx", F.col("x") + F.col("d"))
    back = rows.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("tx"), "y", F.col("d").alias("e"))
    residual = F.abs(F.col("d") + F.col("e"))
    return ahead.join(back, ["vec_id", "tx", "y"]).where(residual <= 1).select("vec_id", "x", "y", residual.alias("residual"))
