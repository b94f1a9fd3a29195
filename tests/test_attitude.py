import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import attitude, fit, raster


def motion(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, acc array<double>, gyro array<double>")


@pytest.mark.parametrize("cell", [10_000_000, 300_000])
def test_a_steady_turn_is_integrated_alike_in_any_cells(spark, cell):
    rate = math.pi / 2
    df = motion(spark, [(k, i * 100_000, [0.0, 0.0, 1.0], [0.0, rate, 0.0]) for k in "ab" for i in range(21)])
    found = {(r["k"], r["t"]): list(r["q"]) for r in attitude.integrate(df, ["k"], "t", "gyro", cell).collect()}
    assert len(found) == 42
    for (_, t), q in found.items():
        half = rate * t / 1e6 / 2
        assert np.allclose(q, [math.cos(half), 0, math.sin(half), 0], atol=1e-10)


def test_many_turns_in_one_interval(spark):
    df = motion(spark, [("a", 0, None, [0.0, 4 * math.pi, 0.0]), ("a", 1_000_000, None, [0.0, 4 * math.pi, 0.0])])
    last = {r["t"]: list(r["q"]) for r in attitude.integrate(df, ["k"], "t", "gyro", 10**9).collect()}[1_000_000]
    assert np.allclose(np.abs(last), [1, 0, 0, 0], atol=1e-8)


def test_fusion(spark):
    tilt = [math.sin(0.3), 0.0, math.cos(0.3)]
    rows = [("tilted", i * 5000, tilt, [0.0, 0.0, 0.0]) for i in range(100)]
    rows += [("yaw", i * 5000, [0.0, 0.0, 1.0], [0.0, 0.0, 2 * math.pi]) for i in range(301)]
    rows += [("shaken", i * 5000, [0.0, 0.0, 3.0], [0.0, 0.0, 0.0]) for i in range(100)]
    rows += [("gap", i * 200_000, tilt, [0.0, 0.0, 0.0]) for i in range(3)] + [("twice", 0, tilt, [0.0] * 3)] * 2
    found = {}
    for r in attitude.gravity_fusion(motion(spark, rows), ["k"], "t", "acc", "gyro").collect():
        found.setdefault(r["k"], []).append(r)
    assert {k: v[0]["status"] for k, v in found.items()} == {"tilted": "ok", "yaw": "ok", "shaken": "no_gravity", "gap": "gap_or_saturation", "twice": "not_monotonic"}
    for r in found["tilted"]:
        assert np.allclose(attitude._rotate(np.array(r["q"]), np.array(tilt)), [0, 0, 1], atol=1e-6)
    end = max(found["yaw"], key=lambda r: r["seconds"])
    assert np.isclose(end["heading"], 3 * math.pi, atol=1e-3)  # a turn and a half, not wrapped


def test_odd_polynomial(spark):
    c = [1.0, -0.1, 0.02, -0.003, 0.0004]
    x = np.arange(0, 1.6, 0.01)
    rows = [("a", float(v), float(sum(k * v ** (2 * i + 1) for i, k in enumerate(c)))) for v in x] + [("b", 1.0, 1.0), ("a", None, 1.0), ("a", float("nan"), 1.0)]
    found = {r["k"]: r["c"] for r in fit.odd_polynomial_fit(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert np.allclose(found["a"], c, atol=1e-5) and found["b"] is None


def test_guided_filter_against_numpy(spark):
    rng = np.random.default_rng(3)
    g, s = rng.integers(0, 255, (2, 6, 7)).astype(float)

    def mean(a, r=2):
        p = np.pad(a, r, mode="reflect")
        return np.array([[p[y : y + 2 * r + 1, x : x + 2 * r + 1].mean() for x in range(a.shape[1])] for y in range(a.shape[0])])

    a = (mean(g * s) - mean(g) * mean(s)) / (mean(g * g) - mean(g) ** 2 + 650.25)
    b = mean(s) - a * mean(g)
    df = spark.createDataFrame([(1, x, y, float(g[y, x]), float(s[y, x])) for y in range(6) for x in range(7)], "p int, x int, y int, g double, s double")
    got = raster.guided_coefficients(df, ["p"], "g", "s", 7, 6, 2, 650.25).collect()
    assert len(got) == 42
    for r in got:
        assert np.isclose(r["a"], mean(a)[r["y"], r["x"]]) and np.isclose(r["b"], mean(b)[r["y"], r["x"]])


def test_bilinear_holds_the_border(spark):
    tile = F.array(*[F.lit(float(v)) for v in (0, 10, 20, 30)])
    row = spark.range(1).select(*[raster.bilinear(tile, F.lit(x), F.lit(y), 2, 2).alias(n) for n, x, y in (("a", 0.5, 0.5), ("b", -3.0, 0.0), ("c", 9.0, 9.0))]).first()
    assert tuple(row) == (15.0, 0.0, 30.0)
