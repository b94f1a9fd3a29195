"""Queries of the scalar library: attitude, lenses, weights, look-ups and colour, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import colour, optics
from tidewell.functions import quaternion as quat
from tidewell.plans.catalog import query, table

_PI = f"CAST({math.pi!r} AS DOUBLE)"
#: Every line item once; the row's own fields number pixels and stand in for colours.
_KEY = ("l_orderkey", "l_linenumber", "l_partkey")
_ITEM = ", ".join(_KEY)
_Q = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT *, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) AS na, sqrt(e[5]*e[5]+e[6]*e[6]+e[7]*e[7]+e[8]*e[8]) AS nb FROM e), q AS (SELECT vec_id, e, e[1]/na AS aw, e[2]/na AS ax, e[3]/na AS ay, e[4]/na AS az, e[5]/nb AS cw, e[6]/nb AS cx, e[7]/nb AS cy, e[8]/nb AS cz FROM n)"
_RAY = f"p AS (SELECT {_ITEM}, ((l_partkey % 512 + 0.5) / CAST(512 AS DOUBLE) - 0.5) * 2 * {_PI} AS lon, (0.5 - (l_orderkey % 256 + 0.5) / CAST(256 AS DOUBLE)) * {_PI} AS lat FROM lineitem), ray AS (SELECT {_ITEM}, cos(lat)*sin(lon) AS x, sin(lat) AS y, cos(lat)*cos(lon) AS z FROM p)"
_RGB = f"rgb AS (SELECT {_ITEM}, l_partkey % 256 AS r, l_orderkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem)"
_RADTAN = [0.02, -0.003, 0.0004, 0.0005, -0.0007]
_PRO = [0.02, -0.003, 0.0004, 0.00001, -0.00002, 0.0005, -0.0007, 0.00003, 0.00004, 0.0002, -0.0001, 0.00005, 0.00006]


def item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item(spark, sf_dir).select(*_KEY, optics.panorama_ray((F.col("l_partkey") % 512).cast("double"), (F.col("l_orderkey") % 256).cast("double"), 512, 256).alias("ray"))


def bytes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item(spark, sf_dir).select(*_KEY, *[(F.col(c) % 256).alias(n) for c, n in (("l_partkey", "r"), ("l_orderkey", "g"), ("l_suppkey", "b"))])


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as two unit quaternions a, b and a vector v."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    q = lambda i: quat.norm(quat.quaternion(*[e(k) for k in range(i, i + 4)]))
    return table(spark, sf_dir, "embeddings").select("vec_id", q(1).alias("a"), q(5).alias("b"), F.struct(*[e(i).alias(n) for i, n in zip((9, 10, 11), "xyz", strict=True)]).alias("v"), F.abs(e(12)).alias("amount"))


def rounded(df: DataFrame, keys, column: str, names) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(f"{column}.{c}"), 6).alias(c) for c in names])


@query(f"WITH {_Q} SELECT vec_id, round(aw*cw-ax*cx-ay*cy-az*cz, 6) AS w, round(aw*cx+ax*cw+ay*cz-az*cy, 6) AS x, round(aw*cy-ax*cz+ay*cw+az*cx, 6) AS y, round(aw*cz+ax*cy-ay*cx+az*cw, 6) AS z FROM q")
def quat_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(poses(spark, sf_dir).select("vec_id", quat.mul(F.col("a"), F.col("b")).alias("p")), ["vec_id"], "p", "wxyz")


@query(f"""WITH {_Q}, d AS (SELECT *, aw*cw+ax*cx+ay*cy+az*cz AS dot, least(greatest(abs(e[12]), 0), 1) AS t FROM q), g AS (SELECT *, CASE WHEN dot < 0 THEN -1.0 ELSE 1.0 END AS s, acos(least(abs(dot), 1)) AS th, abs(dot) > 0.9995 AS near FROM d),
k AS (SELECT *, CASE WHEN near THEN 1 - t ELSE sin((1-t)*th)/sin(th) END AS u, s * CASE WHEN near THEN t ELSE sin(t*th)/sin(th) END AS v FROM g), m AS (SELECT vec_id, aw*u+cw*v AS w, ax*u+cx*v AS x, ay*u+cy*v AS y, az*u+cz*v AS z FROM k), l AS (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS n FROM m)
SELECT vec_id, round(w/n, 6) AS w, round(x/n, 6) AS x, round(y/n, 6) AS y, round(z/n, 6) AS z FROM l""")
def quat_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(poses(spark, sf_dir).select("vec_id", quat.slerp(F.col("a"), F.col("b"), F.col("amount")).alias("p")), ["vec_id"], "p", "wxyz")


@query(f"WITH {_Q}, f AS (SELECT vec_id, 2*(ax*az+aw*ay) AS fx, 1-2*(ax*ax+ay*ay) AS fz, 1-2*(ay*ay+az*az) AS hx, 2*(ax*ay+aw*az) AS hy FROM q) SELECT vec_id, round(atan2(fx, fz), 6) AS yaw, CASE WHEN sqrt(hx*hx+hy*hy) > 0.05 THEN round(atan2(hy, hx), 6) END AS azimuth FROM f")
def quat_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).select("vec_id", F.round(quat.yaw(F.col("a")), 6).alias("yaw"), F.round(quat.azimuth(F.col("a")), 6).alias("azimuth"))


@query(f"""WITH h AS (SELECT {_ITEM}, radians(CAST(l_partkey % 360 AS DOUBLE)) / 2 AS x, radians(CAST(l_orderkey % 360 AS DOUBLE)) / 2 AS y, radians(CAST(l_suppkey % 360 AS DOUBLE)) / 2 AS z FROM lineitem)
SELECT {_ITEM}, round(cos(x)*cos(y)*cos(z)+sin(x)*sin(y)*sin(z), 6) AS w, round(sin(x)*cos(y)*cos(z)-cos(x)*sin(y)*sin(z), 6) AS x, round(cos(x)*sin(y)*cos(z)+sin(x)*cos(y)*sin(z), 6) AS y, round(cos(x)*cos(y)*sin(z)-sin(x)*sin(y)*cos(z), 6) AS z FROM h""")
def quat_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = lambda c: (F.col(c) % 360).cast("double")
    return rounded(item(spark, sf_dir).select(*_KEY, quat.euler(turn("l_partkey"), turn("l_orderkey"), turn("l_suppkey")).alias("p")), _KEY, "p", "wxyz")


@query(f"WITH {_Q}, l AS (SELECT vec_id, e[9] AS x, e[10] AS y, e[11] AS z, sqrt(e[9]*e[9]+e[10]*e[10]+e[11]*e[11]) AS n, abs(e[12]) AS t FROM q) SELECT vec_id, round(cos(t/2), 6) AS w, round(x/n*sin(t/2), 6) AS x, round(y/n*sin(t/2), 6) AS y, round(z/n*sin(t/2), 6) AS z FROM l")
def quat_axis_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(poses(spark, sf_dir).select("vec_id", quat.axis_angle(F.col("v"), F.col("amount")).alias("p")), ["vec_id"], "p", "wxyz")


@query(f"""WITH {_Q}, u AS (SELECT vec_id, 2*(ax*az-aw*ay) AS ux, 2*(ay*az+aw*ax) AS uy, 1-2*(ax*ax+ay*ay) AS uz, e[9] AS vx, e[10] AS vy, e[11] AS vz, sqrt(e[9]*e[9]+e[10]*e[10]+e[11]*e[11]) AS n FROM q), c AS (SELECT *, (vx*ux+vy*uy+vz*uz)/n AS d FROM u)
SELECT vec_id, round(0.5*(vy*uz-vz*uy)/n, 6) AS x, round(0.5*(vz*ux-vx*uz)/n, 6) AS y, round(0.5*(vx*uy-vy*ux)/n, 6) AS z FROM c WHERE abs(n-1) <= 0.9 AND d >= cos(radians(CAST(80 AS DOUBLE)))""")
def gravity_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(poses(spark, sf_dir).select("vec_id", quat.gravity_correction(F.col("a"), F.col("v"), tolerance=0.9, innovation_degrees=80.0).alias("p")).where("p IS NOT NULL"), ["vec_id"], "p", "xyz")


def _omni(bent: str) -> str:
    return f"WITH {_RAY}, d AS (SELECT {_ITEM}, x/(z+1.2*sqrt(x*x+y*y+z*z)) AS x, y/(z+1.2*sqrt(x*x+y*y+z*z)) AS y FROM ray), r AS (SELECT *, x*x+y*y AS r2 FROM d) {bent}"


@query(_omni(f"SELECT {_ITEM}, round((x*(1+0.02*r2-0.003*r2*r2+0.0004*r2*r2*r2) + 2*0.0005*x*y - 0.0007*(r2+2*x*x)) * 400 + 510, 4) AS u, round((y*(1+0.02*r2-0.003*r2*r2+0.0004*r2*r2*r2) - 2*0.0007*x*y + 0.0005*(r2+2*y*y)) * 410 + 490, 4) AS v FROM r WHERE r2 < 4"))
def omni_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays whose undistorted radius is below 2."""
    return _omni_rows(spark, sf_dir, _RADTAN)


@query(_omni(f"""SELECT {_ITEM}, round((x*(1+0.02*r2-0.003*r2*r2+0.0004*r2^3+0.00001*r2^4-0.00002*r2^5) + (0.0005+0.00003*r2)*(r2+2*x*x) + 2*(-0.0007+0.00004*r2)*x*y + 0.0002*r2 + 0.00005*r2*r2) * 400 + 510, 4) AS u,
round((y*(1+0.02*r2-0.003*r2*r2+0.0004*r2^3+0.00001*r2^4-0.00002*r2^5) + (-0.0007+0.00004*r2)*(r2+2*y*y) + 2*(0.0005+0.00003*r2)*x*y - 0.0001*r2 + 0.00006*r2*r2) * 410 + 490, 4) AS v FROM r WHERE r2 < 4"""))
def omni_pro_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _omni_rows(spark, sf_dir, _PRO)


def _omni_rows(spark: SparkSession, sf_dir: str, distortion: list[float]) -> DataFrame:
    seen = rays(spark, sf_dir).select(*_KEY, optics.omni_distorted(F.col("ray"), 1.2, distortion, 400.0, 410.0, 510.0, 490.0, within=2.0).alias("p"))
    return seen.where("p IS NOT NULL").select(*_KEY, F.round("p.u", 4).alias("u"), F.round("p.v", 4).alias("v"))


@query(f"WITH {_RAY}, t AS (SELECT *, sqrt(x*x+y*y) AS a, atan2(sqrt(x*x+y*y), z) AS t FROM ray) SELECT {_ITEM}, round(510 + 400*t*(1+0.03*t-0.02*t*t+0.004*t*t*t)*x/a, 4) AS u, round(490 + 410*t*(1+0.03*t-0.02*t*t+0.004*t*t*t)*y/a, 4) AS v FROM t")
def poly_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rays(spark, sf_dir).select(*_KEY, optics.poly_project(F.col("ray"), [1.0, 0.03, -0.02, 0.004], 400.0, 410.0, 510.0, 490.0).alias("p"))
    return seen.select(*_KEY, F.round("p.u", 4).alias("u"), F.round("p.v", 4).alias("v"))


@query(f"WITH {_RAY}, t AS (SELECT *, sqrt(x*x+y*y) AS a, acos(least(greatest(z, -1), 1)) AS t FROM ray) SELECT {_ITEM}, round(510 + 400*t*(1+0.01*t*t-0.002*t^4+0.0001*t^6)*x/a, 4) AS u, round(490 - 410*t*(1+0.01*t*t-0.002*t^4+0.0001*t^6)*y/a, 4) AS v FROM t")
def equidistant_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rays(spark, sf_dir).select(*_KEY, optics.equidistant_project(F.col("ray"), [0.01, -0.002, 0.0001], 400.0, 410.0, 510.0, 490.0).alias("p"))
    return seen.select(*_KEY, F.round("p.u", 4).alias("u"), F.round("p.v", 4).alias("v"))


@query(f"""WITH {_RAY}, d AS (SELECT {_ITEM}, {_PI}/2 - acos(least(greatest(z/sqrt(x*x+y*y+z*z), -1), 1)) AS d FROM ray), a AS (SELECT {_ITEM}, least(greatest(d/(radians(CAST(190 AS DOUBLE)) - {_PI}) + 0.5, 0), 1) AS a, least(greatest(d/(radians(CAST(204 AS DOUBLE)) - {_PI}) + 0.5, 0), 1) AS i FROM d)
SELECT {_ITEM}, round(CASE WHEN a <= 0.5 THEN 0.5*(2*a)^5.2 ELSE 1 - 0.5*(2*(1-a))^5.2 END, 6) AS detail, round(i, 6) AS illumination FROM a""")
def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rays(spark, sf_dir).select(*_KEY, optics.blend_weights(F.col("ray"), 190.0, 204.0).alias("p"))
    return rounded(seen, _KEY, "p", ("detail", "illumination"))


@query(f"SELECT {_ITEM}, round(CASE WHEN a < 90 THEN 100 + 20 * least(greatest(a / CAST(90 AS DOUBLE), 0), 1) WHEN a < 200 THEN 120 - 70 * (a - 90) / CAST(110 AS DOUBLE) ELSE 64 END, 6) AS radius2, round(greatest(1 + (l_discount - 0.05) * greatest(least(greatest(CAST(l_orderkey % 64 AS DOUBLE), 0), 59) - 20, 0), 0), 6) AS gain FROM (SELECT *, l_partkey % 360 AS a FROM lineitem)")
def mask_radius_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    radius = optics.knots((F.col("l_partkey") % 360).cast("double"), [(0.0, 100.0), (90.0, 120.0), (200.0, 50.0)], 64.0)
    gain = optics.ramp_gain(F.col("l_discount") - 0.05, (F.col("l_orderkey") % 64).cast("double"), 60, 20.0, second=False)
    return item(spark, sf_dir).select(*_KEY, F.round(radius, 6).alias("radius2"), F.round(gain, 6).alias("gain"))


#: A small cube whose entries follow a rule, so that SQL can say them too.
_CUBE = [((3 * (i % 5) + 5 * (i // 5 % 5) + 7 * (i // 25)) % 17) / 16 for i in range(125)]
_CELL = "((3*({0}) + 5*({1}) + 7*({2})) % 17) / CAST(16 AS DOUBLE)"


def _corner(code: str) -> str:
    return _CELL.format(*[f"least(l{c} + {code[i]}, 4)" for i, c in enumerate("rgb")])


_MIX = "({0} + ({1} - {0}) * {2})".format
_FACE = [_MIX(_MIX(_corner(f"00{k}"), _corner(f"10{k}"), "fr"), _MIX(_corner(f"01{k}"), _corner(f"11{k}"), "fr"), "fg") for k in "01"]


@query(f"WITH {_RGB}, p AS (SELECT {_ITEM}, r / CAST(255 AS DOUBLE) * 4 AS r, g / CAST(255 AS DOUBLE) * 4 AS g, b / CAST(255 AS DOUBLE) * 4 AS b FROM rgb), l AS (SELECT {_ITEM}, CAST(floor(r) AS BIGINT) AS lr, CAST(floor(g) AS BIGINT) AS lg, CAST(floor(b) AS BIGINT) AS lb, r - floor(r) AS fr, g - floor(g) AS fg, b - floor(b) AS fb FROM p) SELECT {_ITEM}, round({_MIX(_FACE[0], _FACE[1], 'fb')}, 6) AS value FROM l")
def lut_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = [F.col(c) / 255 for c in "rgb"]
    return bytes_of(spark, sf_dir).select(*_KEY, F.round(colour.lut_trilinear(*unit, colour.grid(_CUBE), 5), 6).alias("value"))


#: A byte table of step 64: edge 254 // 64 + 2.
_BYTES = [(37 * (i // 25) + 53 * (i // 5 % 5) + 29 * (i % 5)) % 256 for i in range(125)]
_BYTE = "((37*least(br + {0}, 4) + 53*least(bg + {1}, 4) + 29*least(bb + {2}, 4)) % 256)"


def _walk(order: str) -> str:
    at, out = [0, 0, 0], []
    for axis in order:
        before = _BYTE.format(*at)
        at[int(axis)] = 1
        out.append(f"({_BYTE.format(*at)} - {before}) * f{'rgb'[int(axis)]}")
    return " + ".join(out)


@query(f"""WITH {_RGB}, s AS (SELECT {_ITEM}, r // 64 AS br, g // 64 AS bg, b // 64 AS bb, r % 64 AS fr, g % 64 AS fg, b % 64 AS fb FROM rgb),
d AS (SELECT {_ITEM}, {_BYTE.format(0, 0, 0)} AS base, CASE WHEN fr > fg AND fg > fb THEN {_walk('012')} WHEN fr > fg AND fr > fb THEN {_walk('021')} WHEN fr > fg THEN {_walk('201')} WHEN fr > fb THEN {_walk('102')} WHEN fg > fb THEN {_walk('120')} ELSE {_walk('210')} END AS d FROM s) SELECT {_ITEM}, CAST(least(greatest(base + sign(d) * (abs(d) // 64), 0), 255) AS INTEGER) AS value FROM d""")
def lut_tetra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = [F.col(c) for c in "rgb"]
    return bytes_of(spark, sf_dir).select(*_KEY, colour.lut_tetrahedral(rgb, colour.grid(_BYTES, "int"), 64, 5).cast("int").alias("value"))


_XYZ = ["({} * r + {} * g + {} * b) / CAST(255 AS DOUBLE)".format(*m) for m in colour.TO_XYZ]
_CUT, _SLOPE = repr((6 / 29) ** 3), repr((29 / 6) ** 2 / 3)


def _flab(t: str) -> str:
    return f"CASE WHEN {t} > {_CUT} THEN {t} ^ (1 / CAST(3 AS DOUBLE)) ELSE {t} * {_SLOPE} + 4 / CAST(29 AS DOUBLE) END"


@query(f"WITH {_RGB}, x AS (SELECT {_ITEM}, {_XYZ[0]} AS x, {_XYZ[1]} AS y, {_XYZ[2]} AS z FROM rgb), f AS (SELECT {_ITEM}, {_flab('x')} AS x, {_flab('y')} AS y, {_flab('z')} AS z FROM x) SELECT {_ITEM}, round(116*y-16, 5) AS l, round(500*(x-y), 5) AS a, round(200*(y-z), 5) AS b FROM f")
def rgb_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = bytes_of(spark, sf_dir).select(*_KEY, colour.rgb_to_lab(*[F.col(c) / 255 for c in "rgb"]).alias("p"))
    return seen.select(*_KEY, *[F.round(F.col(f"p.{c}"), 5).alias(c) for c in "lab"])


@query(f"WITH {_RGB} SELECT {_ITEM}, CAST(least(greatest(round_even((r - 200) / greatest(b / CAST(255 AS DOUBLE), 0.3) + 200, 0), 0), 255) AS INTEGER) AS dehazed, CAST(least(greatest(round_even(r + (g - r) * 0.5, 0), 0), 255) AS INTEGER) AS mixed FROM rgb")
def dehaze_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    return bytes_of(spark, sf_dir).select(*_KEY, colour.dehaze(r, F.lit(200.0), b / 255).alias("dehazed"), colour.lut_blend(r, g, F.lit(0.5)).alias("mixed"))


@query(f"""WITH {_RGB}, m AS (SELECT l_orderkey, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM rgb GROUP BY 1), s AS (SELECT *, greatest(g, b) AS st, least(g, b) AS wk, CASE WHEN g >= b THEN 0.6 ELSE 0.3 END AS am FROM m WHERE g >= 0.1 AND b >= 0.1 AND r <= 254)
SELECT l_orderkey, round(CASE WHEN st = wk THEN 0 ELSE (st-wk)*am/(255-wk)/st END, 8) AS other, round(CASE WHEN b-r > 60 THEN b-r ELSE greatest(1.5*(b-r-20), 0) END * -1 / (255-r) / b, 8) + 0 AS from_blue, round(CASE WHEN g-r > 60 THEN g-r ELSE greatest(1.5*(g-r-20), 0) END * 2 / (255-r) / g, 8) AS from_green FROM s""")
def channel_compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = bytes_of(spark, sf_dir).groupBy("l_orderkey").agg(*[F.avg(c).alias(c) for c in "rgb"])
    gains = means.select("l_orderkey", colour.compensation(*[F.col(c) for c in "rgb"]).alias("p")).where("p IS NOT NULL")
    return gains.select("l_orderkey", *[(F.round(F.col(f"p.{c}"), 8) + F.lit(0.0)).alias(c) for c in ("other", "from_blue", "from_green")])


@query(f"SELECT {_ITEM}, CAST(greatest(round(1920.0 * 960 * (24 + l_linenumber) * ((l_partkey % 4000 + 64) * (l_orderkey % 2000 + 32) / CAST(1920 * 960 AS DOUBLE)) ^ 0.62 * (0.02 + 1.2 * (l_quantity / 100.0) ^ 4)), 100000) AS BIGINT) // 100 AS hundreds FROM lineitem")
def bitrate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = optics.quality_bitrate((F.col("l_partkey") % 4000 + 64).cast("double"), (F.col("l_orderkey") % 2000 + 32).cast("double"), (F.col("l_linenumber") + 24).cast("double"), F.col("l_quantity"))
    return item(spark, sf_dir).select(*_KEY, F.floor(rate / 100).alias("hundreds"))


@query(f"WITH a AS (SELECT {_ITEM}, CAST(l_partkey % 6283 AS DOUBLE) / 1000 - 3 AS angle, CAST(l_orderkey % 40000 AS DOUBLE) / 1000 - 20.0005 AS near FROM lineitem) SELECT {_ITEM}, round(angle + round((near - angle) / (2 * {_PI})) * 2 * {_PI}, 6) AS heading FROM a")
def heading_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item(spark, sf_dir).select(*_KEY, F.round(quat.unwrap((F.col("l_partkey") % 6283).cast("double") / 1000 - 3, (F.col("l_orderkey") % 40000).cast("double") / 1000 - 20.0005), 6).alias("heading"))


@query(f"SELECT {_ITEM}, (2 * l_partkey * 1001000000 + l_suppkey) // nullif(2 * l_suppkey, 0) AS micros, l_partkey * l_suppkey // (l_linenumber * 1001) AS ticks FROM lineitem WHERE l_suppkey > 0")
def ratio_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of a rational time base as microseconds, halves away from zero, and back to whole ticks; exact integers."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    micros = F.expr("(2 * CAST(l_partkey AS DECIMAL(20,0)) * 1001000000 + l_suppkey) div (2 * l_suppkey)")
    ticks = F.expr("(CAST(l_partkey AS DECIMAL(20,0)) * l_suppkey) div (l_linenumber * 1001)")
    return item(spark, sf_dir).where(wide("l_suppkey") > 0).select(*_KEY, micros.cast("long").alias("micros"), ticks.cast("long").alias("ticks"))


@query("""WITH log AS (SELECT *, epoch_us(ts) AS t FROM events), n AS (SELECT user_id, event_id, t, lead(t) OVER w AS nt, greatest(abs(value), abs(lead(value) OVER w)) AS speed FROM log WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, least(CAST(ceil(greatest((nt - t) / CAST(10000000000 AS DOUBLE), (nt - t) / CAST(1000000000000 AS DOUBLE) * speed)) AS BIGINT), 50) AS k FROM n WHERE nt > t) SELECT user_id, event_id, i AS step, t + (nt - t) * i // greatest(k, 1) AS at FROM (SELECT *, unnest(range(1, greatest(k, 1) + 1)) AS i FROM s)""")
def substep_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each interval so that neither time nor angle is too large in one; integer times in between."""
    from tidewell.plans.catalog import log

    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = log(spark, sf_dir).select("user_id", "event_id", "t", F.lead("t").over(order).alias("nt"), F.greatest(F.abs("value"), F.abs(F.lead("value").over(order))).alias("speed")).where("nt > t")
    span = F.col("nt") - F.col("t")
    steps = F.greatest(F.least(F.ceil(F.greatest(span / 10_000_000_000, span / 1_000_000_000_000 * F.col("speed"))), F.lit(50)), F.lit(1))
    return rows.withColumn("k", steps).withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).select("user_id", "event_id", "step", F.expr("t + (nt - t) * step div k").alias("at"))
