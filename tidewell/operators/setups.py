"""Registries of cameras, lenses and physical curves, and calibrations carried over to another optical setup.

The registries are tables of the caller's: lenses (camera, lens_id, optics, fov,
blend, mask), aliases (alias, camera) and curves (lens_id, curve). They are
joined by their keys, and the optimizer broadcasts them while they are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.conversion import STEP, horner, physical_scale, physical_scale_at_edge, sphere_radius
from tidewell.functions.rules import camera_key
from tidewell.operators.fit import odd_polynomial_fit


def named_cameras(df: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Rows with the `camera` of their name, compared by letters and digits; null for unknown and empty names."""
    keys = aliases.select(camera_key(F.col("alias")).alias("__key"), "camera").where("__key != ''").groupBy("__key").agg(F.min("camera").alias("camera"))
    return df.withColumn("__key", camera_key(F.col(name))).join(keys, "__key", "left").drop("__key")


def lens_of(df: DataFrame, lenses: DataFrame) -> DataFrame:
    """Rows (camera, lens_id, ...) with that camera's own profile of the lens, nulls without one."""
    return df.join(lenses, ["camera", "lens_id"], "left")


def lenses_of(df: DataFrame, lenses: DataFrame) -> DataFrame:
    """Rows (lens_id, ...) with every camera's profile of the lens: numbers are shared between cameras."""
    return df.join(lenses, "lens_id")


def curve_of(df: DataFrame, curves: DataFrame, lens: str = "lens_id", name: str = "curve") -> DataFrame:
    return df.join(curves.select(F.col("lens_id").alias(lens), F.col("curve").alias(name)), lens, "left")


def agreed(lenses: DataFrame, alike: Sequence[str], by: str = "lens_id") -> DataFrame:
    """(by, *alike): the profile of each lens that all cameras agree on in the columns `alike`; a null agrees with nulls alone."""
    shape = F.struct(*alike)
    found = lenses.groupBy(by).agg(F.min(shape).alias("low"), F.max(shape).alias("high"))
    return found.where(F.col("low").eqNullSafe(F.col("high"))).select(by, *[F.col(f"low.{c}").alias(c) for c in alike])


def resolved_lens(df: DataFrame, lenses: DataFrame, alike: Sequence[str]) -> DataFrame:
    """Rows (camera, lens_id, ...) with a lens's profile: a known camera's own, else what all cameras agree on."""
    own = lenses.select(F.col("camera").alias("__camera"), F.col("lens_id").alias("__lens"), F.struct(*alike).alias("__own"))
    shared = agreed(lenses, alike).select(F.col("lens_id").alias("__any"), F.struct(*alike).alias("__shared"))
    both = df.join(own, (df["camera"] == F.col("__camera")) & (df["lens_id"] == F.col("__lens")), "left").join(shared, df["lens_id"] == F.col("__any"), "left")
    found = F.coalesce(F.col("__own"), F.when(df["camera"].isNull(), F.col("__shared")))
    return both.select(*[df[c] for c in df.columns], *[found[c].alias(c) for c in alike])


def setup_step(first: Column, second: Column, encoded: Column, requested: Column, version: Column, omni: Column, source_curve: Column, target_curve: Column, auto: str = "auto") -> Column:
    """What a requested optical setup asks of a calibration: keep, convert, or the reason why neither is possible.

    first, second: the lenses' types; encoded: the setup that their type stands for;
    omni: whether both lenses have the model that can be converted.
    """
    return (
        F.when(~first.eqNullSafe(second), "lens_types").when(requested == auto, F.when(encoded.isNotNull(), "keep").otherwise("unmapped")).when(encoded == requested, "keep")
        .when((version != 6) | ~F.coalesce(omni, F.lit(False)), "version").when(source_curve.isNull(), "source_curve").when(target_curve.isNull(), "target_curve").otherwise("convert")
    )


def converted(df: DataFrame, key: str, at_edge: bool = False, own_xi: bool = False, model: tuple[float, float, Sequence[float]] | None = None) -> DataFrame:
    """Calibrations for the curve of another setup: (key, lenses) with xi, focal lengths and the radial terms replaced.

    df: (key, lenses, source_curve, source_fov, target_curve, target_fov), lenses an array
    of structs with xi, fx, fy and distortion (13 terms); one row a calibration. The
    target curve is fitted once, with the first lens's xi, by odd powers of the sphere
    model's radius; each lens keeps its own scale, measured against the source curve. `model`
    (xi, focal length, radial terms) stands for a fit; own_xi: lenses keep their own xi;
    at_edge: the scale is taken at 90 degrees alone. Lenses are null where there is no fit or no positive focal length.
    """
    if model is None:
        xi = F.get("lenses", 0)["xi"]
        angles = df.select(key, xi.alias("xi"), "target_curve", F.explode(F.sequence(F.lit(0), F.floor(F.col("target_fov") * 0.5 / STEP + 0.5).cast("int") - 1)).alias("i"))
        grid = angles.select(key, sphere_radius(F.radians(F.col("i") * STEP), F.col("xi")).alias("u"), horner(F.col("target_curve"), F.col("i") * STEP).alias("r"))
        fit = odd_polynomial_fit(grid, [key], "u", "r").select(key, "c")
        rows = df.join(fit, key, "left").withColumn("__xi", xi).withColumn("__focal", F.get("c", 0))
        radial = F.concat(F.transform(F.slice("c", 2, 4), lambda v: v / F.col("__focal")), F.array(F.lit(0.0)))
    else:
        rows = df.withColumn("__xi", F.lit(float(model[0]))).withColumn("__focal", F.lit(float(model[1])))
        radial = F.array(*[F.lit(float(v)) for v in model[2]])

    def lens(c: Column) -> Column:
        measured = F.sqrt(c["fx"] * c["fy"])
        if at_edge:
            scale = physical_scale_at_edge(c["xi"], measured, c["distortion"], F.col("source_curve"))
        else:
            scale = physical_scale(c["xi"], measured, c["distortion"], F.col("source_curve"), F.col("source_fov"))
        focal = scale * F.col("__focal")
        terms = F.concat(radial, F.slice(c["distortion"], 6, 8))
        new = c.withField("fx", focal).withField("fy", focal).withField("distortion", terms)
        return new if own_xi else new.withField("xi", F.col("__xi"))

    made = F.transform("lenses", lens)
    fine = F.forall(made, lambda c: F.coalesce((c["fx"] > 0) & (F.size(c["distortion"]) == 13), F.lit(False)))
    return rows.withColumn("__made", made).select(key, F.when(fine, F.col("__made")).alias("lenses"))
