"""Motion of whole frames: the turn that steadies each, and the poses of both lenses while their sensors are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import motion
from tidewell.functions import quaternion as quat
from tidewell.operators.alignment import asof_join


def pose_at(df: DataFrame, track: DataFrame, by: list[str], on: str, cell: int) -> DataFrame:
    """Rows with `pose` (shorter arc) and `heading` (straight line) between the track's neighbours; null outside it.

    track: (by, on, pose, heading). Two as-of joins, dealt by clock cells.
    """
    before = asof_join(df, track, by, on, ["pose", "heading"], cell=cell).withColumnsRenamed({f"{on}_match": "__t0", "pose": "__p0", "heading": "__h0"})
    after = asof_join(before, track, by, on, ["pose", "heading"], forward=True, cell=cell).withColumnsRenamed({f"{on}_match": "__t1", "pose": "__p1", "heading": "__h1"})
    span = F.col("__t1") - F.col("__t0")
    after = after.withColumn("__k", F.when(span == 0, 0.0).when(span > 0, (F.col(on) - F.col("__t0")) / span))
    found = after.withColumns({"pose": F.when(F.col("__k").isNotNull(), quat.slerp(F.col("__p0"), F.col("__p1"), F.col("__k"))), "heading": F.col("__h0") + F.col("__k") * (F.col("__h1") - F.col("__h0"))})
    return found.drop("__t0", "__t1", "__p0", "__p1", "__h0", "__h1", "__k")


def frame_motion(frames: DataFrame, track: DataFrame, by: list[str], frame: Sequence[str], on: str, cell: int, n_poses: int = motion.POSES) -> DataFrame:
    """(by, frame, correction, tables, error) of each frame.

    frames: (by, frame, centres, seconds, mode), centres an array with the clock at the middle
    of each lens's exposure, seconds the time that the sensor takes to be read (null or 0:
    none). A table holds the turns from the first lens's pose to the lens's own, evenly
    over the read-out; without one a lens has a table of two equal turns if its centre
    is another than the first lens's, else null. Where the track does not cover a
    time, error is `coverage` and there is neither correction nor table. No table
    has more than n_poses poses, so a frame is a bounded group.
    """
    swept = F.coalesce(F.col("seconds") > 0, F.lit(False))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n_poses - 1)), lambda i: F.struct(i.alias("i"), ((i / (n_poses - 1) - 0.5) * F.col("seconds") * 1e6).alias("off")))
    still = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct(i.alias("i"), F.lit(0.0).alias("off")))
    none = F.filter(still, lambda s: F.lit(False))

    def lens(centre, k):
        wanted = F.when(swept, steps).when(centre != F.get("centres", 0), still).otherwise(none)
        return F.transform(wanted, lambda s: F.struct(k.alias("lens"), s["i"].alias("i"), (centre + s["off"]).cast("double").alias(on)))

    first = F.struct(F.lit(-1).alias("lens"), F.lit(0).alias("i"), F.get("centres", 0).cast("double").alias(on))
    asked = frames.select(*by, *frame, "mode", F.size("centres").alias("__lenses"), F.explode(F.concat(F.array(first), F.flatten(F.transform("centres", lens)))).alias("__ask"))
    asked = asked.select(*by, *frame, "mode", "__lenses", "__ask.*")
    found = pose_at(asked, track.withColumn(on, F.col(on).cast("double")), by, on, cell)
    reference = F.col("lens") == -1
    whole = found.groupBy(*by, *frame).agg(
        F.first("mode").alias("mode"), F.first("__lenses").alias("__lenses"), F.max(F.when(reference, F.col("pose"))).alias("ref"), F.max(F.when(reference, F.col("heading"))).alias("heading"),
        F.max(F.col("pose").isNull()).alias("bad"), F.sort_array(F.collect_list(F.when(~reference, F.struct("lens", "i", "pose")))).alias("all"),
    )
    turns = lambda k: F.transform(F.filter("all", lambda p: p["lens"] == k), lambda p: motion.relative(p["pose"], F.col("ref")))
    tables = F.transform(F.transform(F.sequence(F.lit(0), F.col("__lenses") - 1), turns), lambda t: F.when(F.size(t) > 0, t))
    wanted = motion.target(F.col("mode"), F.col("ref"), F.col("heading"))
    return whole.select(*by, *frame, F.when(~F.col("bad"), quat.mul(quat.inverse(wanted), F.col("ref"))).alias("correction"), F.when(~F.col("bad"), tables).alias("tables"), F.when(F.col("bad"), "coverage").alias("error"))
