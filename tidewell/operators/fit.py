"""Least squares by sums: each key's normal equations are added up before the shuffle and solved once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def odd_polynomial_fit(df: DataFrame, by: Sequence[str], x: str, y: str, terms: int = 5) -> DataFrame:
    """(by, n, c array<double>): y = c0 x + c1 x^3 + ...; null where the equations have no single answer.

    The matrix's entries are sums of even powers, so 3 * terms - 1 sums a key are all that is moved.
    Rows where either value is null or not finite take no part.
    """
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    fine = df.where((F.abs(u) < float("inf")) & (F.abs(v) < float("inf")))
    sums = fine.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(F.pow(u, F.lit(2.0 * k + 2))) for k in range(2 * terms - 1)]).alias("m"), F.array(*[F.sum(F.pow(u, F.lit(2.0 * k + 1)) * v) for k in range(terms)]).alias("r"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for m, r in zip(rows["m"], rows["r"], strict=True):
                matrix = np.array([[m[i + j] for j in range(terms)] for i in range(terms)])
                scale = 1 / np.sqrt(np.maximum(matrix.diagonal(), np.finfo(float).tiny))
                matrix = matrix * scale[:, None] * scale
                fit = np.linalg.matrix_rank(matrix) == terms
                found.append((np.linalg.solve(matrix, np.asarray(r) * scale) * scale).tolist() if fit else None)
            yield rows.drop(columns=["m", "r"]).assign(c=found)

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    return sums.mapInPandas(solve, ", ".join([*kinds, "n long", "c array<double>"]))
