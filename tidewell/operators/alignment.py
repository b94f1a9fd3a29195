"""Joins on clocks: as-of, bracketing, nearest and half-open intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], forward: bool = False, cell: int | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before it (forward: first at or after).

    One sort of both sides together by key and clock, then a running last value:
    a single shuffle, no pair of rows is made that is not in the result. Where
    several right rows share a clock value, the greatest struct of the values
    wins. The time of the match is returned as `<on>_match`.

    With `cell`, a stretch of the clock, a key is dealt out by cells, so that one
    key with much of the rows is many tasks' work; what a cell does not find in
    itself it takes from the last match of the cells before it, of which there
    is one row each. Rows without a clock or key match nothing.
    """
    match = f"{on}_match"
    picked = F.struct(F.col(on).alias(match), *values)
    none = F.lit(None).cast(right.select(picked.alias("s")).schema["s"].dataType)
    others = [c for c in left.columns if c not in (*by, on)]
    top = left.select(*by, on, F.lit(1).alias("__side"), none.alias("__picked"), F.struct(F.lit(0).alias("__"), *others).alias("__row"))
    row_type = top.schema["__row"].dataType
    bottom = right.where(F.col(on).isNotNull()).select(*by, on, F.lit(0).alias("__side"), picked.alias("__picked"), F.lit(None).cast(row_type).alias("__row"))
    clock = F.col(on).desc() if forward else F.col(on)
    both = bottom.unionByName(top)
    keys = list(by)
    if cell:
        both, keys = both.withColumn("__cell", F.floor(F.col(on) / cell)), [*by, "__cell"]
    order = Window.partitionBy(*keys).orderBy(clock, "__side", F.col("__picked").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__picked", ignorenulls=True).over(order)).where(F.col("__side") == 1)
    if cell:
        earlier = Window.partitionBy(*by).orderBy(F.col("__cell").desc() if forward else F.col("__cell")).rowsBetween(Window.unboundedPreceding, -1)
        at = F.struct(-F.col(on) if forward else F.col(on), "__picked")
        cells = both.groupBy(*keys).agg(F.max(F.when(F.col("__side") == 0, at))["__picked"].alias("__last"))
        carried = cells.withColumn("__carry", F.last("__last", ignorenulls=True).over(earlier)).drop("__last")
        same = [found[c].eqNullSafe(carried[c]) for c in keys]
        condition = same[0]
        for s in same[1:]:
            condition &= s
        found = found.join(carried, condition, "left").select(*[found[c] for c in (*by, on, "__row")], F.coalesce(found["__found"], carried["__carry"]).alias("__found"))
    found = found.withColumn("__found", F.when(F.col(on).isNotNull(), F.col("__found")))
    return found.select(*by, on, *[F.col(f"__row.{c}") for c in others], F.col(f"__found.{match}").alias(match), *[F.col(f"__found.{c}").alias(c) for c in values])


def bracket_interp(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, cell: int | None = None) -> DataFrame:
    """Linear interpolation between the right rows about each left row; null outside their span."""
    before = asof_join(left, right, by, on, [value], cell=cell).withColumnsRenamed({f"{on}_match": "__t0", value: "__v0"})
    after = asof_join(before, right, by, on, [value], forward=True, cell=cell).withColumnsRenamed({f"{on}_match": "__t1", value: "__v1"})
    span = F.col("__t1") - F.col("__t0")
    lerp = F.when(span == 0, F.col("__v0")).otherwise(F.col("__v0") + (F.col("__v1") - F.col("__v0")) * ((F.col(on) - F.col("__t0")) / span))
    return after.withColumn(value, F.when(span.isNotNull(), lerp)).drop("__t0", "__v0", "__t1", "__v1")


def interval_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, cell: int) -> DataFrame:
    """Points with the ranges [start, end) they lie in.

    Ranges are entered into each cell of the clock that they touch, so this is a
    plain equality join; choose the cell near the usual length of a range.
    """
    ranges = ranges.where(F.col(end) > F.col(start))
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return points.withColumn("__cell", F.floor(F.col(at) / cell)).join(cells, "__cell").where(inside).drop("__cell")


def pair_join(a: DataFrame, b: DataFrame, by: list[str], key_a: Column, key_b: Column) -> DataFrame:
    """Full outer join of two tracks on exactly equal clock values; `pair_status` tells matched from one-sided rows."""
    left = a.withColumn("__key", key_a).withColumn("__a", F.lit(True))
    right = b.withColumn("__key", key_b).withColumn("__b", F.lit(True))
    both = left.join(right, [*by, "__key"], "full_outer")
    status = F.when(F.col("__a") & F.col("__b"), "matched").when(F.col("__a"), "only_a").otherwise("only_b")
    return both.withColumn("pair_status", status).drop("__a", "__b").withColumnRenamed("__key", "pair_key")
