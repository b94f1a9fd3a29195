import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewell.functions import colour, conversion, motion, seam
from tidewell.operators import frame_motion, masks, ordered, raster, setups

QUATERNION = "struct<w:double,x:double,y:double,z:double>"


def turn(degrees):
    half = math.radians(degrees) / 2
    return Row(w=math.cos(half), x=0.0, y=math.sin(half), z=0.0)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_distances_are_the_cheapest_ways():
    draw = np.random.default_rng(1)
    for shape, zeros in (((9, 13), 0.05), ((1, 7), 0.3), ((7, 1), 0.3), ((2, 2), 0.5), ((20, 20), 0.01)):
        mask = (draw.random(shape) >= zeros).astype(np.uint8)
        mask[shape[0] // 2, 0] = 0
        zy, zx = np.nonzero(mask == 0)
        y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
        a, b = np.abs(y[..., None] - zy), np.abs(x[..., None] - zx)
        hi, lo = np.maximum(a, b), np.minimum(a, b)
        want = np.where(hi >= 2 * lo, (hi - 2 * lo) * raster.STEP + lo * raster.KNIGHT, (hi - lo) * raster.KNIGHT + (2 * lo - hi) * raster.CORNER).min(axis=2)
        assert (raster.distances(mask) == want).all()
    assert (raster.distances(np.ones((4, 4), np.uint8)) == 1 << 32).all()


def test_masks_without_a_picture_have_no_weights(spark):
    rows = spark.createDataFrame([(1, [0, 1, 1, 1]), (2, None), (3, [1]), (4, [1, 1, 1, 1])], "id long, mask array<int>")
    found = {r["id"]: r["weights"] for r in raster.feather(rows, "mask", 2, 2, 0.5).collect()}
    assert found[1] == pytest.approx([0.0, 0.5, 0.5, 91750 / 65536 / 2]) and found[2] is None and found[3] is None and found[4] == [1.0] * 4
    assert raster.feather(rows.limit(0), "mask", 2, 2, 0.5).count() == 0


def test_housing_mask_is_a_disc_cut_back_on_the_far_side():
    whole = masks.housing_mask(60, 40, (20.0, 30.0), 400.0, [(0.0, 400.0), (90.0, 400.0)])
    assert whole.shape == (40, 60) and whole[20, 30] == 1 and not whole[:, 0].any() and not whole[:, -1].any()
    assert whole[20, 12] == 1 and whole[39, 30] == 1
    cut = masks.housing_mask(60, 40, (20.0, 30.0), 400.0, [(0.0, 100.0), (90.0, 100.0)])
    # Only the rows beyond the middle lose pixels, in the band, down to the nearer edge.
    assert (cut[:21] == whole[:21]).all() and cut[29, 30] == 1 and cut[31:, 30].sum() == 0 and cut.sum() < whole.sum()
    square = masks.housing_mask(40, 40, (20.0, 20.0), 900.0, [(0.0, 900.0)])
    assert not square[0].any() and square[1, 1:-1].all()
    assert masks.feathered(square, 0.5)[1, 20] == 0.5


def test_read_out_tables(spark):
    table = lambda *degrees: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in turn(d).asDict().items()]) for d in degrees])
    lit = F.lit
    got = one(
        spark, fine=motion.table_status(table(0, 80, 100), lit(0.0), lit(1.0)), few=motion.table_status(table(0), lit(0.0), lit(1.0)), far=motion.table_status(table(0, 100), lit(0.0), lit(1.0)), empty=motion.table_status(table(0, 1), lit(0.5), lit(0.5)),
        held=motion.uniform_pose(table(0, 40, 80), lit(2.0)), between=motion.uniform_pose(table(0, 40, 80), lit(0.75)),
        up=motion.readout_fraction(lit("up"), lit(0), lit(0), lit(2), lit(2), lit(0.0), lit(1.0)), right=motion.readout_fraction(lit("right"), lit(0), lit(1), lit(2), lit(2), lit(0.5), lit(1.0)),
    )
    assert (got["fine"], got["few"], got["far"], got["empty"]) == ("ok", "count", "step", "interval")
    assert got["held"].asDict() == pytest.approx(turn(80).asDict()) and got["between"].asDict() == pytest.approx(turn(60).asDict())
    assert got["up"] == 0.75 and got["right"] == 0.625


def test_readings_turn_all_or_none(spark):
    v = lambda *c: F.struct(*[F.lit(x).alias(n) for x, n in zip(c, "xyz", strict=True)])
    got = one(spark, fine=motion.all_in_body_axes(F.array(v(1.0, 2.0, 3.0))), bad=motion.all_in_body_axes(F.array(v(1.0, 2.0, 3.0), v(1.0, float("nan"), 0.0))))
    assert got["fine"][0].asDict() == {"x": 2.0, "y": 3.0, "z": 1.0} and got["bad"] is None


def test_frame_motion(spark):
    track = spark.createDataFrame([("r", 0, turn(0), 0.0), ("r", 1000, turn(20), 0.2), ("s", 0, turn(0), 0.0)], f"key string, t long, pose {QUATERNION}, heading double")
    rows = [("r", 1, [500.0, 500.0], 0.0004, "off"), ("r", 2, [500.0, 600.0], None, "lock"), ("r", 3, [100.0, 100.0], 0.0004, "off"), ("r", 4, [500.0, 500.0], None, "follow"), ("x", 5, [1.0, 1.0], None, "lock"), ("s", 6, [0.0, 0.0], 0.0, "lock")]
    shown = spark.createDataFrame(rows, "key string, frame long, centres array<double>, seconds double, mode string")
    found = {r["frame"]: r for r in frame_motion.frame_motion(shown, track, ["key"], ["frame"], "t", 400, n_poses=5).collect()}
    assert found[1]["error"] is None and [len(t) for t in found[1]["tables"]] == [5, 5] and found[1]["correction"]["w"] == pytest.approx(1)
    assert [p["y"] for p in found[1]["tables"][0]] == pytest.approx([turn(d)["y"] for d in (4, 2, 0, -2, -4)])
    assert found[2]["tables"][0] is None and [p["y"] for p in found[2]["tables"][1]] == pytest.approx([turn(-2)["y"]] * 2) and found[2]["correction"].asDict() == pytest.approx(turn(10).asDict())
    assert found[3]["error"] == "coverage" and found[3]["tables"] is None and found[3]["correction"] is None and found[5]["error"] == "coverage"
    assert found[4]["tables"] == [None, None] and found[6]["error"] is None
    assert frame_motion.frame_motion(shown.limit(0), track, ["key"], ["frame"], "t", 400).count() == 0


def measured(xi, focal, radial, curve, degrees):
    theta = np.radians(degrees)
    u = np.sin(theta) / (np.cos(theta) + xi)
    return u, focal * sum(c * u ** (2 * k + 1) for k, c in enumerate([1.0, *radial])), np.polynomial.polynomial.polyval(degrees, curve)


def test_calibration_of_another_setup(spark):
    source, target, tail = [0.0, 0.0171, 1e-6, -3e-7, 0.0], [0.0, 0.0162, 2e-6, -2e-7, 0.0], [0.01 * k for k in range(8)]
    lenses = [Row(xi=1.9, fx=1000.0, fy=1010.0, cx=5.0, distortion=[0.11, -0.02, 0.001, 0.0, 0.0, *tail]), Row(xi=2.0, fx=990.0, fy=990.0, cx=6.0, distortion=[0.1, -0.02, 0.001, 0.0, 0.0, *tail])]
    kind = "id long, lenses array<struct<xi:double,fx:double,fy:double,cx:double,distortion:array<double>>>, source_curve array<double>, source_fov double, target_curve array<double>, target_fov double"
    df = spark.createDataFrame([(1, lenses, source, 204.0, target, 196.0), (2, [x.asDict() | {"distortion": [0.1]} for x in lenses], source, 204.0, target, 196.0)], kind)
    found = {r["id"]: r["lenses"] for r in setups.converted(df, "id").collect()}
    assert found[2] is None
    u, _, r = measured(1.9, 1.0, [], target, np.arange(980) * 0.1)
    c = np.linalg.lstsq(np.stack([u ** (2 * k + 1) for k in range(5)], 1), r, rcond=None)[0]
    for got, own in zip(found[1], lenses, strict=True):
        _, pixel, physical = measured(own["xi"], math.sqrt(own["fx"] * own["fy"]), own["distortion"][:5], source, np.arange(1020) * 0.1)
        scale = (pixel * physical).sum() / (physical * physical).sum()
        assert got["fx"] == got["fy"] == pytest.approx(scale * c[0], rel=1e-6) and got["xi"] == 1.9 and got["cx"] == own["cx"]
        assert got["distortion"][:5] == pytest.approx([*(c[1:] / c[0]), 0.0], rel=1e-4, abs=1e-7) and got["distortion"][5:] == pytest.approx(tail)
    edge = setups.converted(df, "id", at_edge=True, own_xi=True, model=(2.4, 9.0, [1.0, 2.0, 3.0, 4.0, 0.0])).where("id = 1").first()["lenses"]
    assert edge[1]["xi"] == 2.0 and edge[1]["distortion"][:5] == [1.0, 2.0, 3.0, 4.0, 0.0]


def test_scales_that_are_none(spark):
    none = F.array(*[F.lit(0.0)] * 5)
    got = one(spark, flat=conversion.physical_scale(F.lit(1.0), F.lit(900.0), none, none, F.lit(180.0)), empty=conversion.physical_scale(F.lit(1.0), F.lit(900.0), none, none, F.lit(0.0)), edge=conversion.physical_scale_at_edge(F.lit(1.0), F.lit(900.0), none, none))
    assert got["flat"] is None and got["empty"] is None and got["edge"] is None


def test_cameras_by_name(spark):
    aliases = spark.createDataFrame([("Cam X-4", "x4"), ("camx4air", "x4air"), ("--", "none")], "alias string, camera string")
    rows = spark.createDataFrame([("cam x4",), ("CAM X4 Air",), ("other",), ("",), (None,)], "name string")
    assert {r["name"]: r["camera"] for r in setups.named_cameras(rows, aliases).collect()} == {"cam x4": "x4", "CAM X4 Air": "x4air", "other": None, "": None, None: None}


def test_rays_turn_with_the_field(spark):
    ray = F.struct(*[F.lit(v).alias(n) for n, v in (("x", 0.6), ("y", 0.8), ("z", 0.0))])
    still, level = motion.identity(), lambda v: F.array_repeat(F.lit(v), 32)
    got = one(spark, none=seam.plan_direction(ray, still, 0.5, level(0.0), level(0.0), 8, 4), quarter=seam.plan_direction(ray, still, 0.5, level(2.0), level(0.0), 8, 4), down=seam.plan_direction(ray, still, 0.5, level(0.0), level(1.0), 8, 4), out=seam.plan_direction(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z")), still, 0.5, level(2.0), level(0.0), 8, 4))
    assert got["none"].asDict() == {"x": 0.6, "y": 0.8, "z": 0.0} and got["out"].asDict() == {"x": 0.0, "y": 0.0, "z": 1.0}
    assert got["quarter"].asDict() == pytest.approx({"x": -0.8, "y": 0.6, "z": 0.0}) and got["down"]["z"] == pytest.approx(math.cos(math.pi / 2 + 0.25))


def test_strength_of_a_restoration(spark):
    rgb = lambda *c: F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", c, strict=True)])
    a, b = rgb(0.2, 0.4, 0.6), rgb(0.5, 0.3, 0.1)
    got = one(spark, none=colour.strength_mix(a, b, F.lit(0.5), F.lit(0.0)), whole=colour.strength_mix(a, b, F.lit(1.0), F.lit(1.0)), same=colour.strength_mix(a, a, F.lit(0.5), F.lit(0.7)))
    assert list(got["none"]) == [0.2, 0.4, 0.6] and list(got["whole"]) == pytest.approx([0.5, 0.3, 0.1], abs=2e-3) and list(got["same"]) == pytest.approx([0.2, 0.4, 0.6], abs=2e-3)


def test_preview_session(spark):
    draw = np.random.default_rng(2)
    rows = [(k, i, float(draw.integers(0, 9)) if i % 7 else None, [float(i), float(k)]) for k in (1, 2) for i in range(200)]
    rows[0] = (1, 0, 0.0, None)
    found = ordered.preview_session(spark.createDataFrame(rows, "key long, i long, frames double, grid array<double>"), ["key"], ["i"], "frames", "grid")
    got = {(r["key"], r["i"]): r for r in found.collect()}
    assert len(got) == 400 and got[(1, 0)]["update"] and got[(1, 0)]["feature"] and got[(1, 0)]["grid"] is None and got[(2, 0)]["grid"] == [0.0, 2.0]
    for k in (1, 2):
        now, last, feature, grid = 0.0, None, None, None
        for i in range(200):
            now += rows[(k - 1) * 200 + i][2] or 0
            r = got[(k, i)]
            due = last is None or now - last >= 10
            assert r["update"] == due and r["feature"] == (due and (feature is None or now - feature >= 60))
            if due:
                keep = 0.0 if last is None else 0.8 ** ((now - last) / 10)
                new = rows[(k - 1) * 200 + i][3]
                grid = grid if new is None else np.array(new) if grid is None else keep * grid + (1 - keep) * np.array(new)
                last, feature = now, now if r["feature"] else feature
            assert r["grid"] is None if grid is None else r["grid"] == pytest.approx(list(grid))
    assert ordered.preview_session(spark.createDataFrame([], found.sparkSession.createDataFrame(rows, "key long, i long, frames double, grid array<double>").schema), ["key"], ["i"], "frames", "grid").count() == 0
