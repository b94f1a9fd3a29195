"""Decision tables, per-key agreement and allow lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The outcome of the first rule that holds; a null condition does not."""
    out = F
    for condition, outcome in rules:
        out = out.when(condition, outcome if isinstance(outcome, Column) else F.lit(outcome))
    return out.otherwise(otherwise)


def merged(explicit: Column, detected: Column, auto: str = "auto") -> Column:
    """An explicit choice wins over a detected one; null (ambiguous) where neither says anything."""
    return F.when(explicit != auto, explicit).otherwise(detected)


def allowed(value: Column, names: Column, fold: bool = False) -> Column:
    """Whether a list names the value; an empty list allows everything, a null value nothing else."""
    same = F.exists(names, lambda n: (F.lower(n) == F.lower(value)) if fold else (n == value))
    return (F.size(names) == 0) | F.coalesce(same, F.lit(False))


def agreement(df: DataFrame, by: Sequence[str], properties: Sequence[str]) -> DataFrame:
    """For each key, the number of rows and each property's status: constant, conflict or absent.

    One aggregate of least and greatest values, which combine before the shuffle;
    nulls take no part.
    """
    def status(c: str) -> Column:
        least, most = F.min(c), F.max(c)
        return F.when(least.isNull(), "absent").when(least == most, "constant").otherwise("conflict").alias(c)

    return df.groupBy(*by).agg(F.count("*").alias("n"), *[status(c) for c in properties])


def safe_relative(path: Column) -> Column:
    """Whether a path stays inside its root: not empty, not absolute, no empty, `.` or `..` part, no backslash or drive."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce((F.length(path) > 0) & ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit(":")) & ~bad, F.lit(False))
