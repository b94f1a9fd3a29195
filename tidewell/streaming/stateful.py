"""Streaming twins: rows out of order dropped, exponential means with state, statistics of windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def ema_with_reset(stream: DataFrame, by: list[str], clock: str, value: str, rate: float) -> DataFrame:
    """(by, clock, ema): the batch operator's fold carried over micro-batches; the clock is a long.

    State is one clock and one mean a key. A batch is sorted before it is folded,
    so an earlier clock in a later batch begins anew, as it does in one batch
    where the clock stands. Rows with a null clock or value are dropped.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, mean = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(parts)).sort_values([clock, value])
        out = []
        for t, v in zip(rows[clock], rows[value], strict=True):
            mean = v if last is None or t <= last else rate * mean + (1 - rate) * v
            last = t
            out.append(mean)
        state.update((int(last), float(mean)))
        yield rows[[*by, clock]].assign(ema=out)

    rows = stream.select(*by, F.col(clock).cast("long"), F.col(value).cast("double")).where(F.col(clock).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(*by).applyInPandasWithState(fold, f"{_keys(stream, by)}, {clock} long, ema double", "last long, mean double", "append", GroupStateTimeout.NoTimeout)


def strictly_later(stream: DataFrame, by: list[str], clock: str) -> DataFrame:
    """Rows of each key whose clock is later than all that came before; of equal clocks one stays. State is one clock a key."""
    names = stream.columns

    def keep(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(clock).drop_duplicates(clock)
        if state.exists:
            rows = rows[rows[clock] > state.get[0]]
        if len(rows):
            state.update((int(rows[clock].iloc[-1]),))
            yield rows[names]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.where(F.col(clock).isNotNull()).groupBy(*by).applyInPandasWithState(keep, kinds, "last long", "append", GroupStateTimeout.NoTimeout)


def window_statistics(stream: DataFrame, by: list[str], at: str, width: str, late: str, value: Column) -> DataFrame:
    """(by, start, n, total, least, most) of each window of event time, given out when the watermark has passed it."""
    rows = stream.withWatermark(at, late).groupBy(*by, F.window(at, width).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(*by, F.col("w.start").alias("start"), "n", "total", "least", "most")


def first_of_key(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """One row of each key within the watermark; keys older than it are forgotten."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
