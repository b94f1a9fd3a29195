import math

from pyspark.sql import functions as F

from tidewell.functions import rules
from tidewell.operators import sequences


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_names_of_a_pair(spark):
    rows = spark.createDataFrame([("a/v_00_1.rec",), ("a/V_10_1.REC",), ("b/v_10_2.rec",), ("b/alone.rec",), ("b/v_00_3.rec",), ("b/note.txt",), ("c/x_00_y_00_.rec",)], "path string")
    found = {(r["folder"], r["identity"]): (r["paths"], r["error"]) for r in sequences.input_sets(rows, extension="rec").collect()}
    assert found == {
        ("a/", "V_XX_1.REC"): (["a/v_00_1.rec", "a/V_10_1.REC"], None), ("b/", "V_XX_2.REC"): (["b/v_10_2.rec"], "no_primary"), ("b/", "alone.rec"): (["b/alone.rec"], None),
        ("b/", "V_XX_3.REC"): (["b/v_00_3.rec"], None), ("c/", "X_XX_Y_00_.REC"): (["c/x_00_y_00_.rec"], None),
    }


def test_chapters_of_a_capture(spark):
    kind = "recording string, split boolean, invalid boolean, identity string, capture_type long, idx int, total int, duration long, serial string"
    rows = [("b", True, False, "x", 1, 5, 0, 7, "s"), ("a", True, False, "x", 1, 2, 3, 10, "s"), ("o", True, False, "x", 2, 2, 0, 4, "s"), ("w", False, False, None, None, None, None, 9, None), ("n", True, False, "", 1, 1, 0, 9, "s"), ("d", True, False, "y", 1, 1, 0, 9, "s"), ("e", True, False, "y", 1, 1, 0, 9, "s"), ("f", True, False, "z", 1, 1, 2, 9, "s"), ("g", True, False, "z", 1, 2, 3, 9, "s"), ("h", True, False, "u", 1, 1, 0, 9, "s"), ("i", True, False, "u", 1, 2, 0, 9, "t"), ("j", False, None, None, None, None, None, 0, "s")]
    found = sequences.chapters(spark.createDataFrame(rows, kind), ["serial"])
    got = {r["recording"]: (r["n_chapters"], r["start"], r["complete"], r["error"]) for r in found.collect()}
    assert got["a"] == (2, 0, False, None) and got["b"] == (2, 10, False, None) and got["o"] == (1, 0, False, None) and got["w"] == (1, 0, True, None)
    assert got["n"][3] == "no_identity" and {got[c][3] for c in "de"} == {"duplicate_index"} and {got[c][3] for c in "fg"} == {"totals"} and {got[c][3] for c in "hi"} == {"incompatible"} and got["j"][3] == "no_duration"
    assert sorted(r["recording"] for r in sequences.discovered(found, "a").collect()) == ["a", "b"]
    assert [r["recording"] for r in sequences.whole_only(found).collect()] == ["w"]


def test_packed_proof_needs_each_centre_in_its_half(spark):
    lit = F.lit
    centres = lambda a, b: F.array(*[F.struct(lit(x).alias("x"), lit(50.0).alias("y")) for x in (a, b)])
    proof = lambda name, c, width=400: rules.packed_proof(lit(name), lit(2), lit(1), lit(1), lit(None).cast("int"), lit(width), lit(200), F.struct(lit(200).alias("w"), lit(100).alias("h")), c)
    got = one(spark, fine=proof("VID_1", centres(50.0, 150.0)), swapped=proof("VID_1", centres(150.0, 50.0)), border=proof("VID_1", centres(100.0, 150.0)), name=proof("LRV_1", centres(50.0, 150.0)), size=proof("VID_1", centres(50.0, 150.0), 404))
    assert got.asDict() == {"fine": True, "swapped": False, "border": False, "name": False, "size": False}


def test_clocks_and_readout(spark):
    lit, none = F.lit, F.lit(None)
    crop = F.struct(*[lit(v).alias(k) for k, v in (("sw", 4000), ("sh", 4000), ("dw", 3840), ("dh", 3840), ("x", 80), ("y", -80))])
    off = F.struct(*[lit(v).alias(k) for k, v in (("sw", 4000), ("sh", 4000), ("dw", 3840), ("dh", 3840), ("x", 81), ("y", 0))])
    empty = F.array().cast("array<int>")
    got = one(
        spark, moved=rules.gyro_adjustment(lit(True), lit(1.5)), off=rules.gyro_adjustment(lit(False), none.cast("double")), bare=rules.gyro_adjustment(none.cast("boolean"), lit(1.0)), nan=rules.gyro_adjustment(none.cast("boolean"), lit(math.nan)),
        sweep=rules.readout(lit(1), empty, crop, lit(8.0)), outside=rules.readout(lit(1), empty, off, lit(8.0)), turned=rules.readout(none.cast("int"), empty, crop, lit(8.0)), field=rules.timing(F.array(lit(64)), none.cast("double"), none.cast("long"), none.cast("double")),
        start=rules.capture_start(lit(True), none.cast("double"), none.cast("long"), lit(7)), lapse=rules.capture_start(lit(True), none.cast("double"), lit(5), lit(7)),
    )
    assert got["moved"]["us"] == 1500 and got["off"]["us"] == 0 and got["bare"]["error"] == got["nan"]["error"] == "no_flag"
    assert got["sweep"]["seconds"] == 0.008 and got["outside"]["error"] == "crop_outside" and got["turned"]["error"] == "ambiguous" and got["field"] == "malformed"
    assert got["start"] == 7 and got["lapse"] is None


def test_windows_ranges_and_planes(spark):
    field = lambda *pairs: F.array(*[F.struct(F.lit(n).alias("number"), F.lit(v).cast("long").alias("value")) for n, v in pairs])
    lit = F.lit
    got = one(
        spark, crop=rules.crop_window(field((1, 9), (1, 10), (2, 8), (3, 6), (4, 5), (5, 2**64 - 2 - 2**64))), zero=rules.crop_window(field((1, 10), (2, 0), (3, 6), (4, 5))), part=rules.crop_window(field((1, 10))),
        both=rules.imu_range(lit(16), lit(2000)), none=rules.imu_range(lit(0), lit(2000)), fits=rules.plane_fits(lit(8), lit(28), lit(4), lit(4)), short=rules.plane_fits(lit(8), lit(27), lit(4), lit(4)),
        key=rules.camera_key(lit("One X-2 (Pro)")), old=rules.generation_accepted(lit(2), F.array(lit(3))), tracks=rules.declared_tracks(lit(4), lit(2)),
    )
    assert got["crop"].asDict() == {"sw": 10, "sh": 8, "dw": 6, "dh": 5, "x": -2, "y": 0} and got["zero"] is None and got["part"] is None
    assert got["both"]["acc_g"] == 16.0 and got["none"] is None and got["fits"] and not got["short"] and got["key"] == "onex2pro" and not got["old"] and tuple(got["tracks"]) == (2, False)
