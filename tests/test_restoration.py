import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import colour
from tidewell.operators import raster, restoration as r

KIND = "rec string, n int, t double, rgb binary"
W, H = 40, 32


def scene(seed, shade=(60, 120, 140)):
    draw = np.random.default_rng(seed)
    return np.clip(np.array(shade) + draw.integers(-40, 41, (H, W, 1)) + draw.integers(-9, 10, (H, W, 3)), 0, 255).astype(np.uint8)


def plain(frames, strength=1.0, balance=0.5):
    """The same, one frame after the other."""
    power = light = last = None
    for t, p in frames:
        if last is not None and t <= last:
            power = light = None
        last = t
        found = r.gains(p, strength, balance) if strength else None
        if found is None:
            yield p
            continue
        p = r.compensated(p, found)
        now = r.exponent(p)
        if now is not None:
            power = now if power is None else r.RATE * power + (1 - r.RATE) * now
        p = r.brightened(p, power, strength)
        small = r.shrunk(p, H // 4, W // 4)
        now = r.air(small, r.grey(small))
        light = now if light is None or not light.any() else r.RATE * light + (1 - r.RATE) * now
        yield r.cleared(p, light, strength)


def test_frames_follow_each_other(spark):
    one = [(float(i if i < 6 else i - 4), scene(i, (60 + 5 * i, 120, 140 - i))) for i in range(10)]
    two = [(0.0, scene(50)), (1.0, np.zeros((H, W, 3), np.uint8)), (2.0, scene(51))]
    rows = [("one", i, t, p.tobytes()) for i, (t, p) in enumerate(one)] + [("two", i, t, p.tobytes()) for i, (t, p) in enumerate(two)]
    rows += [("odd", 0, 0.0, None), ("odd", 1, None, scene(1).tobytes()), ("odd", 2, 1.0, b"123"), ("odd", 3, float("nan"), scene(1).tobytes()), (None, 0, 0.0, scene(9).tobytes())]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = {(x["rec"], x["n"]): x["rgb"] for x in r.restored(df, ["rec"], "n", "t", "rgb", W, H).collect()}
    assert len(got) == len(rows)
    for name, frames in (("one", one), ("two", two), (None, [(0.0, scene(9))])):
        for i, p in enumerate(plain(frames)):
            assert bytes(got[(name, i)]) == p.tobytes(), (name, i)
    assert all(got[("odd", i)] is None for i in range(4)) and bytes(got[("two", 1)]) == two[1][1].tobytes()
    assert bytes(got[("one", 0)]) != one[0][1].tobytes()
    assert [bytes(x["rgb"]) for x in r.restored(df, ["rec"], "n", "t", "rgb", W, H, strength=0.0).where("rec = 'one' AND n = 3").collect()] == [one[3][1].tobytes()]
    assert r.restored(df.limit(0), ["rec"], "n", "t", "rgb", W, H).count() == 0


def test_parts_against_the_column_forms(spark):
    p = scene(3)
    small = r.shrunk(p, H // 4, W // 4)
    rows = spark.range(H // 4 * (W // 4)).select((F.col("id") % (W // 4)).alias("x"), F.floor(F.col("id") / (W // 4)).alias("y"), F.lit(p[..., 0].ravel().tolist()).alias("t"))
    for x in rows.select("x", "y", raster.resize_stepwise(F.col("t"), F.col("x"), F.col("y"), (W, H), (W // 4, H // 4)).alias("v")).collect():
        assert small[x["y"], x["x"], 0] == x["v"]
    means = [float(v) for v in p[::4, ::4].reshape(-1, 3).mean(axis=0)]
    column = spark.range(1).select(colour.compensation(*map(F.lit, means)).alias("g")).first()["g"]
    assert r.gains(p, 1.0, 0.5)[1:] == pytest.approx((column["other"], column["from_blue"], column["from_green"]))


def test_windows_and_lines():
    draw = np.random.default_rng(4)
    v = draw.random((9, 11))
    for radius in (0, 1, 3):
        want = np.array([[v[max(y - radius, 0) : y + radius + 1, max(x - radius, 0) : x + radius + 1].min() for x in range(11)] for y in range(9)])
        assert (r.extreme(v, radius, np.min) == want).all()
    mirror = lambda i, n: min(i % (2 * n - 2), 2 * n - 2 - i % (2 * n - 2))
    for radius in (1, 15):
        want = [[np.mean([v[mirror(y + j, 9), mirror(x + i, 11)] for j in range(-radius, radius + 1) for i in range(-radius, radius + 1)]) for x in range(11)] for y in range(9)]
        assert r.mean_square(v, radius) == pytest.approx(np.array(want))
    # A field that is a line of the guide comes back nearly whole, and a level one exactly.
    guide = draw.integers(0, 256, (32, 48)).astype(float)
    assert r.guided(guide, np.full((32, 48), 0.7)) == pytest.approx(np.full((32, 48), 0.7))
    assert r.air(np.array([[[9, 9, 9], [200, 180, 190]]] * 2, np.uint8), np.array([[9, 185]] * 2)).tolist() == [200.0, 180.0, 190.0]
