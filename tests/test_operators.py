import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import optics
from tidewell.functions import quaternion as quat
from tidewell.operators import alignment, ordered, publish
from tidewell.sources import records


def test_asof_ties_and_edges(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (1, 11, "c"), (2, 7, "d")], "k int, t long, name string")
    right = spark.createDataFrame([(1, 10, 1.0), (1, 10, 3.0), (1, 12, 9.0)], "k int, t long, v double")
    back = {r["name"]: r["v"] for r in alignment.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert back == {"a": None, "b": 3.0, "c": 3.0, "d": None}
    ahead = {r["name"]: (r["v"], r["t_match"]) for r in alignment.asof_join(left, right, ["k"], "t", ["v"], forward=True).collect()}
    assert ahead == {"a": (3.0, 10), "b": (3.0, 10), "c": (9.0, 12), "d": (None, None)}


def test_interval_is_half_open(spark):
    points = spark.createDataFrame([(0,), (9,), (10,), (25,)], "t long")
    ranges = spark.createDataFrame([(0, 0, 10), (1, 10, 20), (2, 20, 20)], "c int, s long, e long")
    got = sorted((r["t"], r["c"]) for r in alignment.interval_join(points, ranges, "t", "s", "e", 7).collect())
    assert got == [(0, 0), (9, 0), (10, 1)]


def test_rotation_of_a_quarter_turn(spark):
    half = 2**-0.5
    q = quat.quaternion(F.lit(half), F.lit(0.0), F.lit(half), F.lit(0.0))
    v = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    turned = quat.rotate(q, v)
    back = quat.rotate(quat.inverse(q), turned)
    same = quat.slerp(q, q, F.lit(0.5))
    row = spark.range(1).select(turned.alias("a"), back.alias("b"), same.alias("c"), quat.mul(q, quat.inverse(q)).alias("d")).first()
    assert np.allclose(list(row["a"]), [1, 0, 0], atol=1e-12)
    assert np.allclose(list(row["b"]), [0, 0, 1], atol=1e-12)
    assert np.allclose(list(row["c"]), [half, 0, half, 0], atol=1e-12)
    assert np.allclose(list(row["d"]), [1, 0, 0, 0], atol=1e-12)


def test_optics(spark):
    centre = optics.panorama_ray(F.lit(255.5), F.lit(127.5), 512, 256)
    seen = optics.omni_project(centre, 1.0, 100.0, 100.0, 50.0, 60.0)
    row = spark.range(1).select(seen.alias("p"), optics.yuv_to_rgb(F.lit(235), F.lit(128), F.lit(128)).alias("white"), optics.poly_radius(F.lit(2.0), [1.0, 0.5]).alias("r"), optics.smoothstep(F.lit(0.5)).alias("s")).first()
    assert np.allclose(list(row["p"]), [50, 60]) and np.allclose(list(row["white"]), [255, 255, 255])
    assert row["r"] == 4.0 and row["s"] == 0.5


@pytest.mark.parametrize("cell", [1, 3, 100])
def test_ema_resets_where_the_clock_stands(spark, cell):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 2, 9.0), ("a", 4, 9.0)], "k string, t long, v double")
    got = sorted((r["t"], round(r["ema"], 6)) for r in ordered.ema_with_reset(df, ["k"], "t", "v", 0.5, cell).collect())
    assert got == [(1, 1.0), (2, 2.0), (2, 9.0), (4, 9.0)]


def test_records(spark):
    good = struct.pack("<Q6H", 7, 32768, 49152, 0, 32768, 32768, 32768)
    frame = spark.createDataFrame([("a", bytearray(good * 2)), ("b", bytearray(b"xyz")), ("c", None)], "recording string, payload binary")
    rows = records.motion_samples(frame, raw=True)
    out = rows.where("status = 'ok'").select(records.scaled_axes(F.col("axis"), 32.0, 2000.0).alias("s")).first()["s"]
    assert list(out["acc"]) == [0.0, 16.0, -32.0] and list(out["gyro"]) == [0.0, 0.0, 0.0]
    assert sorted(r["recording"] for r in rows.where("status = 'bad_size'").collect()) == ["b", "c"]
    message = bytes([0x08, 0x96, 0x01, 0x12, 0x02, 0x68, 0x69])
    found = records.protobuf_fields(spark.createDataFrame([("m", bytearray(message)), ("n", bytearray(b"\x08"))], "recording string, payload binary"))
    got = sorted((r["recording"], r["number"], r["value_long"], r["value_bin"] and bytes(r["value_bin"]), r["status"]) for r in found.collect())
    assert got[0] == ("m", 1, 150, None, "ok") and got[1] == ("m", 2, None, b"hi", "ok") and got[2][0] == "n" and got[2][4] == "truncated"


def test_publish_never_replaces(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    publish.publish(spark.range(5), target)
    with pytest.raises(FileExistsError):
        publish.publish(spark.range(6), target)
    assert spark.read.parquet(target).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_verified(spark):
    df = spark.createDataFrame([("abc", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("abc", 4, ""), ("abc", 3, "00")], "c string, n int, d string")
    assert [r["status"] for r in publish.verified(df, "c", "n", "d").collect()] == ["ok", "wrong_length", "wrong_digest"]


@pytest.mark.parametrize("forward", [False, True])
def test_asof_by_cells_equals_asof(spark, forward):
    left = spark.range(400).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 211).alias("t"), F.col("id").alias("name"))
    left = left.unionByName(spark.createDataFrame([(None, 5, 1000), (1, None, 1001)], "k long, t long, name long"))
    right = spark.range(40).select((F.col("id") % 3).alias("k"), (F.col("id") * 53 % 173 + 20).alias("t"), F.col("id").alias("v"))
    whole, dealt = (sorted(map(tuple, alignment.asof_join(left, right, ["k"], "t", ["v"], forward=forward, cell=c).collect()), key=repr) for c in (None, 10))
    assert whole == dealt and len(whole) == 402
    sides = {(k, t): v for k, t, v in right.collect()}
    for k, t, _, match, v in whole:
        times = [x for kk, x in sides if kk == k and t is not None and (x >= t if forward else x <= t)]
        best = (min if forward else max)(times) if times else None
        assert match == best and v == (sides[k, best] if times else None)


def test_quaternions_of_great_length_and_near_arcs(spark):
    big = quat.norm(quat.quaternion(F.lit(3e200), F.lit(4e200), F.lit(0.0), F.lit(0.0)))
    a, b = quat.norm(quat.quaternion(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))), quat.norm(quat.quaternion(F.lit(-1.0), F.lit(0.0), F.lit(0.01), F.lit(0.0)))
    row = spark.range(1).select(big.alias("q"), quat.norm(quat.quaternion(*[F.lit(0.0)] * 4)).alias("none"), quat.slerp(a, b, F.lit(0.5)).alias("m"), quat.axis_angle(F.struct(*[F.lit(0.0).alias(c) for c in "xyz"]), F.lit(0.0)).alias("i")).first()
    assert np.allclose(list(row["q"]), [0.6, 0.8, 0, 0]) and row["none"] is None and list(row["i"]) == [1, 0, 0, 0]
    assert np.isclose(np.linalg.norm(list(row["m"])), 1) and np.isclose(row["m"]["y"], -0.005, atol=1e-6)
