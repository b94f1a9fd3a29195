"""Recordings of several files: pairs of lens files, and chapters of one capture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.rules import pair_name

#: Chapters of one recording at most.
MOST_CHAPTERS = 4096


def input_sets(files: DataFrame, path: str = "path", extension: str | None = None) -> DataFrame:
    """(folder, identity, paths, error): files of one recording, the primary lens first.

    Files pair up by their folder and name; a secondary without its primary is an
    error, and so are two files of one kind. Other files stand alone. With an
    extension, files of another one take no part.
    """
    rows = files.select(F.col(path).alias("path"))
    if extension:
        rows = rows.where(F.endswith(F.lower("path"), F.lit(f".{extension.lower()}")))
    found = pair_name(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.select("path", F.substring("path", F.lit(1), F.length("path") - F.length(name)).alias("folder"), F.coalesce(found["identity"], name).alias("identity"), F.coalesce(found["kind"], F.lit("alone")).alias("kind"))
    # Three of a kind are as wrong as two, so no set grows with the files.
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("path")))
    sets = rows.groupBy("folder", "identity").agg(count("primary").alias("p"), count("secondary").alias("s"), count("alone").alias("a"), *[first(k).alias(k) for k in ("primary", "secondary", "alone")])
    error = F.when((F.col("p") > 1) | (F.col("s") > 1) | (F.col("a") > 1) | ((F.col("a") > 0) & (F.col("p") + F.col("s") > 0)), "duplicate").when((F.col("p") == 0) & (F.col("s") > 0), "no_primary")
    return sets.select("folder", "identity", F.array_compact(F.array("primary", "secondary", "alone")).alias("paths"), error.alias("error"))


def chapters(rows: DataFrame, alike: Sequence[str], recording: str = "recording") -> DataFrame:
    """Chapters with their recording's `group`, `n_chapters`, `start`, `complete` and `error`.

    rows: one for each input set, with `recording` (its name), `split` (whether it declares itself part of
    a split capture), `invalid`, `identity`, `capture_type`, `idx`, `total` and `duration`;
    alike: columns that all chapters of a capture must share. A set that is not split
    is a whole recording by itself. Split chapters of one identity and capture type are
    one, in order of their index; whether all its parts are there cannot be known. `start`
    is the duration of the chapters before.
    """
    split = F.coalesce(F.col("split"), F.lit(False))
    rows = rows.withColumn("__named", split & (F.coalesce(F.length("identity"), F.lit(0)) > 0) & ~F.coalesce(F.col("invalid"), F.lit(False)))
    rows = rows.withColumn("group", F.when(F.col("__named"), F.struct(F.col("identity").alias("identity"), F.col("capture_type").alias("capture_type"), F.lit(None).cast("string").alias("alone"))).otherwise(F.struct(F.lit(None).cast("string").alias("identity"), F.lit(None).cast(rows.schema["capture_type"].dataType).alias("capture_type"), F.col(recording).cast("string").alias("alone"))))
    shape = F.to_json(F.struct(*alike))
    total = F.when(F.col("total") != 0, F.col("total"))
    agreed = rows.groupBy("group").agg(
        F.count("*").alias("n_chapters"), F.countDistinct("idx").alias("n_idx"), F.min(total).alias("low"), F.max(total).alias("high"),
        F.min(shape).alias("least"), F.max(shape).alias("most"), F.max((F.coalesce(F.col("duration"), F.lit(0)) <= 0).cast("int")).alias("empty"), F.max((split & ~F.col("__named")).cast("int")).alias("unnamed"),
    )
    error = (
        F.when(F.col("unnamed") == 1, "no_identity").when(F.col("empty") == 1, "no_duration").when(F.col("n_chapters") > MOST_CHAPTERS, "too_many").when(F.col("low") != F.col("high"), "totals")
        .when(F.col("least") != F.col("most"), "incompatible").when((F.col("n_chapters") > 1) & (F.col("n_idx") < F.col("n_chapters")), "duplicate_index")
    )
    agreed = agreed.select("group", "n_chapters", error.alias("error"))
    before = Window.partitionBy("group").orderBy("idx", recording).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(agreed, "group").withColumn("start", F.coalesce(F.sum("duration").over(before), F.lit(0))).withColumn("complete", ~split & F.col("error").isNull()).drop("__named")


def discovered(found: DataFrame, selected: str, recording: str = "recording") -> DataFrame:
    """The chapters that belong to the recording of a selected input set."""
    own = found.where(F.col(recording) == selected).select("group").distinct()
    return found.join(own, "group", "left_semi")


def whole_only(found: DataFrame) -> DataFrame:
    """Chapters of recordings that are known to be complete."""
    return found.where("complete AND error IS NULL")
