import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_container import box, movie, trailer
from tidewell import api
from tidewell.functions import calibration, colour
from tidewell.sources import luts, records, telemetry

V3 = "2_" + "_".join(["1.5_400_410_500.5_510_1_2_3_0.1_0.2_0.3_0.01_0.02_0.03_0.04_0.05_2000_1000_113"] * 2) + f"_{3 * 65536 + 7}"
V1 = "2_" + "_".join(["400_500_510_1_2_3"] * 2) + f"_2000_1000_{1024 + 41}"


def test_offsets(spark):
    df = spark.createDataFrame([("a", V3, V1), ("b", V3[:-3], V1), ("c", "2_x", None), ("d", V3.replace("_2000", "_2001", 1), "")], "k string, v3 string, v1 string")
    v3, v1 = F.col("v3"), F.col("v1")
    rows = {r["k"]: r for r in df.select("k", calibration.status(v3, 3).alias("s3"), calibration.status(v1, 1).alias("s1"), calibration.pick({3: v3, 1: v1})["version"].alias("v"), calibration.plausible(v3).alias("p")).collect()}
    assert [rows[k]["s3"] for k in "abcd"] == ["ok", "version_word", "field_count", "canvas_differs"]
    assert [rows[k]["s1"] for k in "abcd"] == ["ok", "ok", "empty", "empty"] and [rows[k]["v"] for k in "abcd"] == [3, 1, None, None]
    assert rows["a"]["p"] and not rows["c"]["p"]
    two = df.where("k = 'a'").select(calibration.lens(v3, 3, 1).alias("l"), calibration.lens(v1, 1, 0).alias("m"), calibration.encode(calibration.numbers(v3)).alias("e")).first()
    assert two["l"]["xi"] == 1.5 and two["l"]["fy"] == 410 and two["l"]["distortion"] == [0.01, 0.02, 0.03, 0.04, 0.05] and two["l"]["lens_type"] == 113
    assert two["m"]["fx"] == two["m"]["fy"] == 400 and two["m"]["canvas_w"] == 2000 and two["m"]["lens_type"] == 41 and two["e"] == V3


def test_rules(spark):
    angles = [r[0] for r in spark.createDataFrame([(None,), (0,), (190,), (90,)], "b int").select(calibration.blend_angle(F.col("b"), F.lit(200))).collect()]
    assert angles == [200.0, 200.0, 190.0, None]
    c, scale = calibration.polynomial([9.0, 2.0, 0.0, 0.0, 0.0], 180.0)
    assert c == [1.0, 0.0, 0.0, 0.0] and np.isclose(scale, 180 / np.pi / 90)


def test_cube(spark):
    rows = [f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1)]
    cube = luts.parse_cube('TITLE "a # b"\n# note\nLUT_3D_SIZE 2\n' + "\n".join(rows))
    got = spark.range(1).select(*[colour.lut_trilinear(F.lit(0.2), F.lit(0.5), F.lit(1.7), colour.grid(cube.channel(c)), 2).alias(str(c)) for c in range(3)]).first()
    assert np.allclose(list(got), [0.2, 0.5, 1.0])
    for bad in ("LUT_3D_SIZE 1\n", "LUT_3D_SIZE 2\n0 0 0", "0 0 0", "LUT_1D_SIZE 2", "LUT_3D_SIZE 2\n" + "\n".join([*rows, "0 0 0"]), "LUT_3D_SIZE 2\nDOMAIN_MIN 1 1 1\n" + "\n".join(rows), "LUT_3D_SIZE 2\n" + "\n".join([*rows[:-1], "0 nan 0"])):
        with pytest.raises(ValueError):
            luts.parse_cube(bad)


def field(number, value):
    if isinstance(value, int):
        out = b""
        while True:
            value, low = value >> 7, value & 127
            out += bytes([low | (128 if value else 0)])
            if not value:
                return bytes(v for v in _key(number, 0)) + out
    return _key(number, 2) + bytes([len(value)]) + value


def _key(number, wire):
    key = number << 3 | wire
    return bytes([key]) if key < 128 else bytes([key & 127 | 128, key >> 7])


def test_metadata(spark):
    message = field(1, b"S1") + field(2, b"cam") + field(1, b"S2") + field(62, 1) + field(24, 77) + field(200, b"zz") + field(3, b"\xff")
    twice = field(26, b"a") + field(26, b"b")
    fields = records.protobuf_fields(spark.createDataFrame([("m", bytearray(message)), ("n", bytearray(twice))], "recording string, payload binary"))
    row = telemetry.metadata(fields).where("recording = 'm'").first()
    assert (row["serial"], row["camera"], row["firmware"], row["is_raw_gyro"], row["first_frame"]) == ("S2", "cam", None, True, 77)
    assert [(u["number"], bytes(u["value_bin"])) for u in row["unknown"]] == [(200, b"zz")]
    assert {r["recording"]: r["state"] for r in telemetry.agreed(fields, 26).collect()} == {"m": "absent", "n": "conflict"}


def test_exposure_on_the_media_clock(spark):
    data = struct.pack("<qdqd", 900_000, 1 / 100, 1_033_333, 1 / 150)
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"x" * 15)), ("c", bytearray(struct.pack("<qd", 1, float("nan")))), ("d", bytearray(struct.pack("<qdqd", 2_000_000, 0.1, 2_000_000, 0.1)))], "recording string, payload binary")
    rows = telemetry.exposure_samples(df)
    assert {r["recording"]: r["status"] for r in rows.where("status <> 'ok'").collect()} == {"b": "bad_size", "c": "bad_shutter"}
    timed = telemetry.media_clock(rows.where("status = 'ok'"), ["recording"], F.col("ts"), F.lit(True), F.lit(1_000_000).cast("long"), F.lit(None).cast("double")).collect()
    assert [(r["t_us"], r["shutter_ns"]) for r in timed if r["recording"] == "a"] == [(33_333, 6_666_667)]
    assert {r["clock_status"] for r in timed if r["recording"] == "d"} == {"not_monotonic"}


def test_probe_and_extract(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = struct.pack("<Q6H", 7, *[32768] * 6) * 2
    good = movie([(3, 1001)]) + box(b"mdat", bytes(9)) + trailer([(1, 0, field(1, b"S1")), (3, 0, raw)])
    (tmp_path / "in/good.bin").write_bytes(good)
    (tmp_path / "in/bad.bin").write_bytes(good[:100])
    rows = {r["path"][-8:]: r for r in api.probe(spark, f"{tmp_path}/in").collect()}
    assert (rows["good.bin"]["n_records"], rows["good.bin"]["n_frames"], rows["good.bin"]["last_pts_us"]) == (2, 3, 66733)
    assert [r["path"][-7:] for r in api.preflight(spark, f"{tmp_path}/in").collect()] == ["bad.bin"]
    made = api.extract(spark, f"{tmp_path}/in", f"file://{tmp_path}/out")
    assert spark.read.parquet(made["motion"]).where("status = 'ok'").count() == 2 and spark.read.parquet(made["metadata"]).first()["number"] == 1
    with pytest.raises(FileExistsError):
        api.extract(spark, f"{tmp_path}/in", f"file://{tmp_path}/out")
