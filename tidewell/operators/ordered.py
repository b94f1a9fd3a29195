"""Operators over rows in order: prefix sums, gaps, sessions, circular and reflected windows, ordered folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType


def running_start(df: DataFrame, by: list[str], order: list[str], length: str, name: str = "start") -> DataFrame:
    """Sum of the lengths before each row."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(length).over(before), F.lit(0)))


def sessions(df: DataFrame, by: list[str], order: list[str], new: Column, name: str = "session") -> DataFrame:
    """Number of the session of each row: how many rows so far begin one."""
    return df.withColumn(name, F.sum(F.when(new, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def circular_mean(df: DataFrame, by: list[str], place: str, size: int, value: Column, before: int, after: int, name: str = "mean") -> DataFrame:
    """Mean over a window of places that wraps around at `size`."""
    shifts = F.array(*[F.lit(k * size) for k in (-1, 0, 1)])
    wide = df.withColumn("__copy", F.explode(shifts)).withColumn("__at", F.col(place) + F.col("__copy")).where(F.col("__at").between(-before, size - 1 + after))
    window = Window.partitionBy(*by).orderBy("__at").rangeBetween(-before, after)
    return wide.withColumn(name, F.avg(value).over(window)).where(F.col("__copy") == 0).drop("__copy", "__at")


def reflect(place: Column, size: int) -> Column:
    """Places beyond a border mirrored at it, the border itself not repeated."""
    return F.when(place < 0, -place).when(place >= size, 2 * (size - 1) - place).otherwise(place)


def ema_with_reset(df: DataFrame, by: list[str], clock: str, value: str, rate: float, cell: int) -> DataFrame:
    """Exponential mean of each key in clock order, begun anew where the clock does not increase.

    Each row maps the mean before it to rate * mean + (1 - rate) * value, or to its
    value alone where the mean begins anew; such maps compose. So each clock cell of
    a key is folded by itself, the cells' maps (one row each) are chained, and a
    long key is many tasks. Equal clocks lie in one cell. Rows with a null clock
    or value take no part.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    rows = df.select(*by, F.col(clock).cast("long").alias(clock), F.col(value).cast("double").alias(value)).where(F.col(clock).isNotNull() & F.col(value).isNotNull())
    inside = Window.partitionBy(*by, "__cell").orderBy(clock, value)
    rows = rows.withColumn("__cell", F.floor(F.col(clock) / cell)).withColumn("__last", F.lag(clock).over(inside))
    anew = F.col(clock) <= F.col("__last")
    rows = rows.withColumn("__new", F.col("__last").isNull()).withColumn("__a", F.when(anew, F.col(value)).otherwise((1 - rate) * F.col(value))).withColumn("__b", F.when(anew, 0.0).otherwise(rate))
    # The window has sorted the rows, and mapInArrow leaves them so.
    local = rows.select(*by, "__cell", clock, F.col(value).alias("__value"), "__new", "__a", "__b").mapInArrow(_composed, f"{kinds}, __cell long, {clock} long, __value double, __new boolean, __a double, __b double, __at long")
    ends = local.groupBy(*by, "__cell").agg(F.max_by(F.struct("__a", "__b"), "__at").alias("__end"), F.min_by("__value", "__at").alias("__first"))
    cells = Window.partitionBy(*by).orderBy("__cell")
    first = F.lag("__cell").over(cells).isNull()
    # A first value is its own mean: the first cell's map is applied to it.
    ends = ends.select(*by, "__cell", first.alias("__new"), F.when(first, F.col("__end.__a") + F.col("__end.__b") * F.col("__first")).otherwise(F.col("__end.__a")).alias("__a"), F.when(first, 0.0).otherwise(F.col("__end.__b")).alias("__b"), "__first")
    chained = ends.mapInArrow(_composed, f"{kinds}, __cell long, __new boolean, __a double, __b double, __first double, __at long")
    carries = chained.select(*by, "__cell", F.coalesce(F.lag("__a").over(cells), "__first").alias("__carry"))
    return local.join(carries, [*by, "__cell"]).select(*by, clock, (F.col("__a") + F.col("__b") * F.col("__carry")).alias("ema"))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maps x -> __a + __b * x of all rows up to each, from the last row with __new on, and the row's place there.

    By doubling: each round composes a map with that of twice as many rows, for a
    whole batch at once.
    """
    at, a_before, b_before = -1, 0.0, 1.0
    for batch in batches:
        if not batch.num_rows:
            continue
        new, a, b = (np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("__new", "__a", "__b"))
        place = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        open_ = np.maximum.accumulate(new) == 0
        place[open_] = at + 1 + np.arange(int(open_.sum()))
        if open_[0]:
            a[0], b[0] = a[0] + b[0] * a_before, b[0] * b_before
        reach = np.minimum(place, np.arange(len(new)))  # rows before each that its map takes in
        k = 1
        while k <= reach.max():
            rows = np.flatnonzero(reach >= k)
            a[rows], b[rows] = a[rows] + b[rows] * a[rows - k], b[rows] * b[rows - k]
            k *= 2
        at, a_before, b_before = int(place[-1]), a[-1], b[-1]
        columns = {n: batch.column(n) for n in batch.schema.names} | {"__a": pa.array(a), "__b": pa.array(b), "__at": pa.array(place)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


#: Frames between updates, updates between features, and what an update keeps of the grid after one interval.
INTERVAL, FEATURES, KEPT = 10, 6, 0.8


def preview_session(df: DataFrame, by: list[str], order: list[str], frames: str, grid: str) -> DataFrame:
    """Rows (by, order) with `update`, `feature`, `kept` and the smoothed `grid` of each shown frame.

    frames: how many source frames went by since the last shown one; grid: the frame's own
    array. An update is due where INTERVAL source frames have passed since the last one,
    a feature with each update FEATURES intervals after the last. An update keeps
    KEPT to the power of the intervals since then of the grid before; other frames show the
    grid as it stands. The first frame of a key is both, and keeps nothing.

    When the next update is due depends on the last, so a key is one stream through one task,
    a batch and one grid at a time. Null frames count as none; a null grid changes nothing.
    """
    kept = [*by, *order]
    schema = StructType([*[df.schema[c] for c in kept], StructField("update", BooleanType()), StructField("feature", BooleanType()), StructField("kept", DoubleType()), StructField("grid", ArrayType(DoubleType()))])
    rows = df.select(*kept, F.coalesce(F.col(frames).cast("double"), F.lit(0.0)).alias("__frames"), F.col(grid).cast("array<double>").alias("__grid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, updated, featured, shown = object(), 0.0, None, None, None
        for batch in batches:
            out: list[tuple] = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            for own, passed, cells in zip(keys, batch.column("__frames").to_pylist(), batch.column("__grid"), strict=True):
                if own != key:
                    key, now, updated, featured, shown = own, 0.0, None, None, None
                now += passed
                update = updated is None or now - updated >= INTERVAL - 1e-6
                feature = update and (featured is None or now - featured >= FEATURES * INTERVAL - 1e-6)
                share = 0.0 if updated is None else KEPT ** ((now - updated) / INTERVAL)
                if update:
                    updated = now
                    if cells.is_valid:
                        new = cells.values.to_numpy(zero_copy_only=False)
                        shown = new if shown is None else share * shown + (1 - share) * new
                if feature:
                    featured = now
                out.append((update, feature, share, shown))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.float64())), strict=True)]], schema.names)

    dealt = rows.repartition(*by) if by else rows.coalesce(1)
    return dealt.sortWithinPartitions(*kept).mapInArrow(run, schema)
