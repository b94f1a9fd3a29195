"""Pictures as rows: small tiles as arrays in one row, large ones as long tables of pixels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def pixel(tile: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """A pixel of a row-major tile, the nearest one for places outside."""
    at = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    return F.get(tile, at(y, height) * width + at(x, width))


def bilinear(tile: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """Four taps about a place; the border is held."""
    x, y = F.least(F.greatest(x, F.lit(0.0)), F.lit(width - 1.0)), F.least(F.greatest(y, F.lit(0.0)), F.lit(height - 1.0))
    left, top = F.floor(x), F.floor(y)
    fx, fy = x - left, y - top
    tap = lambda dx, dy: pixel(tile, left + dx, top + dy, width, height)
    return (tap(0, 0) * (1 - fx) + tap(1, 0) * fx) * (1 - fy) + (tap(0, 1) * (1 - fx) + tap(1, 1) * fx) * fy


def low_pass(tile: Column, x: Column, y: Column, width: int, height: int, step: int = 1, weights: Sequence[int] = (1, 4, 6, 4, 1)) -> Column:
    """Mean of taps `step` apart in both directions, weighted by the products of the weights; the border is held."""
    far, total = len(weights) // 2, sum(weights) ** 2
    taps = [pixel(tile, x + (i - far) * step, y + (j - far) * step, width, height) * (a * b) for i, a in enumerate(weights) for j, b in enumerate(weights)]
    out = taps[0]
    for t in taps[1:]:
        out = out + t
    return out / total


def reflected_mean(df: DataFrame, by: Sequence[str], place: str, size: int, radius: int, values: Sequence[str]) -> DataFrame:
    """Mean of each value over places at most `radius` away along one axis, mirrored at the border without repeating it.

    Only pixels near a border are doubled; the rest is one window over a line of
    pixels, so the work does not grow with the square of the radius.
    """
    images = F.array(F.col(place), F.when((F.col(place) > 0) & (F.col(place) <= radius), -F.col(place)), F.when((F.col(place) < size - 1) & (F.col(place) >= size - 1 - radius), 2 * (size - 1) - F.col(place)))
    wide = df.withColumn("__at", F.explode(F.filter(images, lambda p: p.isNotNull())))
    near = Window.partitionBy(*by).orderBy("__at").rangeBetween(-radius, radius)
    return wide.withColumns({v: F.avg(v).over(near) for v in values}).where(F.col("__at") == F.col(place)).drop("__at")


def box_mean(df: DataFrame, by: Sequence[str], width: int, height: int, radius: int, values: Sequence[str]) -> DataFrame:
    """Mean over a square of a picture of pixels (by, x, y): rows, then columns."""
    return reflected_mean(reflected_mean(df, [*by, "y"], "x", width, radius, values), [*by, "x"], "y", height, radius, values)


def guided_coefficients(df: DataFrame, by: Sequence[str], guide: str, source: str, width: int, height: int, radius: int, epsilon: float) -> DataFrame:
    """(by, x, y, a, b): the smoothed local lines source = a * guide + b."""
    g, s = F.col(guide), F.col(source)
    moments = box_mean(df.select(*by, "x", "y", g.alias("mg"), s.alias("ms"), (g * g).alias("gg"), (g * s).alias("gs")), by, width, height, radius, ["mg", "ms", "gg", "gs"])
    lines = moments.withColumn("a", (F.col("gs") - F.col("mg") * F.col("ms")) / (F.col("gg") - F.col("mg") * F.col("mg") + epsilon))
    return box_mean(lines.select(*by, "x", "y", "a", (F.col("ms") - F.col("a") * F.col("mg")).alias("b")), by, width, height, radius, ["a", "b"])


def mask_weight(mask: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """Four taps about a place of a mask of weights; none outside the picture."""
    inside = (x >= 0) & (y >= 0) & (x <= width - 1) & (y <= height - 1)
    return F.when(F.coalesce(inside, F.lit(False)), bilinear(mask, x, y, width, height)).otherwise(0.0)


def masked_bilinear(tile: Column, mask: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """Mean of the taps about a place, by their shares, of those that the mask lets through; 0 without any."""
    left, top = F.floor(x), F.floor(y)
    fx, fy = x - left, y - top
    total, support = F.lit(0.0), F.lit(0.0)
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            share = F.when(pixel(mask, left + dx, top + dy, width, height) > 0, wx * wy).otherwise(0.0)
            total, support = total + pixel(tile, left + dx, top + dy, width, height) * share, support + share
    return F.when(support > 0, total / support).otherwise(0.0)


def _around(x: Column, y: Column, width: int, height: int) -> list[tuple[Column, Column]]:
    """(place in the array, share) of the four taps; columns wrap around, the last row is held."""
    x = F.pmod(x, F.lit(float(width)))
    left, top = F.floor(x), F.floor(y)
    fx, fy = x - left, y - top
    row = lambda d: F.least(top + d, F.lit(height - 1))
    return [((row(j) * width + (left + i) % width).cast("int"), wx * wy) for j, wy in ((0, 1 - fy), (1, fy)) for i, wx in ((0, 1 - fx), (1, fx))]


def wrapped_sample(tile: Column, valid: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """Four taps of a picture that goes round in azimuth; null where a tap that counts is invalid or above or below the picture."""
    total, fine = F.lit(0.0), (y >= 0) & (y <= height - 1)
    for at, share in _around(x, y, width, height):
        total, fine = total + F.when(share > 0, F.get(tile, at) * share).otherwise(0.0), fine & ((share <= 0) | F.get(valid, at))
    return F.when(fine, total)


def field_sample(dx: Column, dy: Column, confidence: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """(dx, dy, confidence) of a field of shifts that goes round in azimuth: taps count by share and confidence; zeros above, below and where nothing is trusted."""
    taps = _around(x, y, width, height)
    trust = sum((F.get(confidence, at) * share for at, share in taps[1:]), F.get(confidence, taps[0][0]) * taps[0][1])
    moved = [sum((F.get(v, at) * F.get(confidence, at) * share for at, share in taps), F.lit(0.0)) for v in (dx, dy)]
    inside = F.coalesce((y >= 0) & (y <= height - 1), F.lit(False))
    used = F.when(inside, trust).otherwise(0.0)
    return F.struct(*[F.when(used > 0, m / trust).otherwise(0.0).alias(n) for m, n in zip(moved, ("dx", "dy"), strict=True)], used.alias("confidence"))


def displacement_sample(dx: Column, dy: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """(dx, dy) of a field whose shifts are final: plain shares; zeros above and below."""
    inside = F.coalesce((y >= 0) & (y <= height - 1), F.lit(False))
    return F.struct(*[F.when(inside, sum((F.get(v, at) * share for at, share in _around(x, y, width, height)), F.lit(0.0))).otherwise(0.0).alias(n) for v, n in ((dx, "dx"), (dy, "dy"))])


def _grid(place: Column, size: int, out: int) -> tuple[Column, Column, Column]:
    """(first tap, its share and the next one's in 2048ths) of a place of a resized line; the border is held."""
    at = F.least(F.greatest((place + 0.5) * (size / out) - 0.5, F.lit(0.0)), F.lit(size - 1.0))
    part = at - F.floor(at)
    return F.floor(at), F.rint((1 - part) * 2048).cast("long"), F.rint(part * 2048).cast("long")


def _resized(tile: Column, x: Column, y: Column, size: tuple[int, int], out: tuple[int, int]) -> tuple[Column, Column, Column, Column]:
    (left, a0, a1), (top, b0, b1) = _grid(x, size[0], out[0]), _grid(y, size[1], out[1])
    line = lambda d: pixel(tile, left, top + d, *size) * a0 + pixel(tile, left + 1, top + d, *size) * a1
    return line(0), line(1), b0, b1


def resize_stepwise(tile: Column, x: Column, y: Column, size: tuple[int, int], out: tuple[int, int]) -> Column:
    """Byte of a picture resized in whole numbers of 11 bits, low bits dropped after each line and halves rounded up at the end."""
    upper, lower, b0, b1 = _resized(tile, x, y, size, out)
    cut = lambda line, b: F.shiftright(b * F.shiftright(line, 4), 16)
    return F.shiftright(cut(upper, b0) + cut(lower, b1) + 2, 2).cast("int")


def resize_at_once(tile: Column, x: Column, y: Column, size: tuple[int, int], out: tuple[int, int]) -> Column:
    """Byte of a picture resized in whole numbers of 11 bits, rounded once from 22."""
    upper, lower, b0, b1 = _resized(tile, x, y, size, out)
    return F.least(F.greatest(F.shiftright(upper * b0 + lower * b1 + (1 << 21), 22), F.lit(0)), F.lit(255)).cast("int")


def in_disc(x: Column, y: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """Pixels that a filled circle of whole centre and radius covers.

    Scan conversion by the mid-point rule keeps, for each row, the widest extent
    whose squares sum to the squared radius at most, which is this test.
    """
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius


#: Costs in 65536ths of a step to the next pixel, across a corner, and by a knight's move.
STEP, CORNER, KNIGHT = 65_536, 91_750, 143_976


def distances(mask: np.ndarray) -> np.ndarray:
    """Cheapest way of each pixel to a pixel that is 0, in 65536ths; 2**32 without any.

    Two sweeps over the rows, each whole row at a time: what comes from the two
    rows before is a shifted minimum, what comes along the row is a running
    minimum of the cost less that of the way there.
    """
    far = 1 << 32
    found = np.where(mask == 0, 0, far).astype(np.int64)
    height, width = found.shape
    along = np.arange(width, dtype=np.int64) * STEP

    def sweep(d: np.ndarray) -> None:
        for r in range(height):
            row = d[r]
            for back, moves in ((1, ((0, STEP), (1, CORNER), (2, KNIGHT))), (2, ((1, KNIGHT),))):
                if r < back:
                    continue
                before = d[r - back]
                for shift, cost in moves:
                    if shift < width:
                        np.minimum(row[shift:], before[: width - shift] + cost, out=row[shift:])
                        np.minimum(row[: width - shift], before[shift:] + cost, out=row[: width - shift])
            for line in (row, row[::-1]):
                np.minimum(line, np.minimum.accumulate(line - along) + along, out=line)

    sweep(found)
    sweep(found[::-1])
    return np.minimum(found, far)


def feather(df: DataFrame, mask: str, width: int, height: int, per_pixel: float, name: str = "weights") -> DataFrame:
    """Masks (arrays of 0 and 1, row by row) with weights that grow from 0 at their zeros by `per_pixel`, to 1 at most.

    One row is one picture, so a task holds one at a time. A null mask, or one of another size, has null weights.
    """
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cells in batch.column(mask):
                cells = None if not cells.is_valid else cells.values.to_numpy(zero_copy_only=False)
                fits = cells is not None and len(cells) == width * height
                out.append(np.minimum(distances(cells.reshape(height, width)).ravel() / STEP * per_pixel, 1.0) if fits else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def coverage(df: DataFrame, by: Sequence[str], confidence: str, least: float = 0.5) -> DataFrame:
    """(by, coverage): share of a field's vectors that are trusted."""
    return df.groupBy(*by).agg(F.avg((F.coalesce(F.col(confidence), F.lit(0.0)) >= least).cast("double")).alias("coverage"))
