"""Clocks are long integers of microseconds or nanoseconds; nothing here uses a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(column: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def rational_key(ticks: Column, num: Column | int, other_den: Column | int) -> Column:
    """A tick count as an exact number that is equal across time bases num/den: ticks * num * the other side's den."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return ticks.cast("decimal(19,0)") * as_column(num).cast("decimal(9,0)") * as_column(other_den).cast("decimal(9,0)")
