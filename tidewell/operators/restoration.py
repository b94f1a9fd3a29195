"""Restoration of underwater pictures: channel gains, brightness and haze, steadied from frame to frame.

What a frame needs of the frames before it are four numbers, so a recording is not
one task's work: pictures are measured in parallel, the measures alone run through
each recording in order, and the pictures are finished in parallel with what came
out. That is done twice, as the haze is measured on the brightened picture.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

#: What a frame keeps of the measure before it; weights of grey in 32768ths; the share of haze taken away; the least transmission.
RATE, GREY, HAZE, LEAST = 0.98, (9798, 19235, 3735), 0.45, 0.3
#: Radius and epsilon of the guided filter; part of the smaller side that the dark channel's square has as radius.
RADIUS, EPSILON, SQUARE = 15, 0.01 * 255 * 255, 54


def byte(v: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(v), 0, 255).astype(np.uint8)


def grey(p: np.ndarray) -> np.ndarray:
    return (p.astype(np.int64) @ np.array(GREY) + (1 << 14)) >> 15


def gains(p: np.ndarray, strength: float, balance: float) -> tuple[int, float, float, float] | None:
    """(weaker of green and blue, its gain from the stronger, red's from blue, red's from green); None leaves a picture as it is."""
    red, green, blue = p[::4, ::4].reshape(-1, 3).mean(axis=0)
    if green < 0.1 or blue < 0.1 or red > 254:
        return None
    tilt, weaker = 2 * (balance - 0.5), 2 if green >= blue else 1
    strong, weak = max(green, blue), min(green, blue)
    lead = [v if v > 60 else max(1.5 * (v - 20), 0.0) for v in (blue - red, green - red)]
    other = 0.0 if strong == weak else (strong - weak) * (0.6 if weaker == 2 else 0.3) * strength / (255 - weak) / strong
    return weaker, other, lead[0] * (tilt - 1) * strength / (255 - red) / blue, lead[1] * (2 - tilt) * strength / (255 - red) / green


def compensated(p: np.ndarray, found: tuple[int, float, float, float]) -> np.ndarray:
    weaker, other, from_blue, from_green = found
    out, v = p.copy(), p.astype(float)
    out[..., weaker] = byte(v[..., weaker] + other * (255 - v[..., weaker]) * v[..., 3 - weaker])
    out[..., 0] = byte(v[..., 0] + (255 - v[..., 0]) * (from_blue * v[..., 2] + from_green * v[..., 1]))
    return out


def exponent(p: np.ndarray) -> float | None:
    """Power that brings a picture's mean grey to one and a half times of it, 0.55 at most."""
    mean = grey(p).mean() / 255
    return math.log(min(1.5 * mean, 0.55)) / math.log(mean) if 0 < mean < 1 else None


def brightened(p: np.ndarray, power: float | None, strength: float) -> np.ndarray:
    power = 0.0 if power is None else strength * (power - 1)
    if power >= 0:
        return p
    value = np.arange(1, 256)
    more = np.concatenate(([0.0], np.minimum((value / 255) ** power - 1, 2) * value))
    return byte(p + more[grey(p)][..., None])


def places(size: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second tap of each place of a resized line, and the share of the second."""
    at = np.clip((np.arange(out) + 0.5) * size / out - 0.5, 0, size - 1)
    low = at.astype(int)
    return low, np.minimum(low + 1, size - 1), at - low


def shrunk(p: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resized in whole numbers of 11 bits, as `raster.resize_stepwise`."""
    (y0, y1, dy), (x0, x1, dx) = places(p.shape[0], height), places(p.shape[1], width)
    q = p.astype(np.int64)
    share = lambda d: (np.rint((1 - d) * 2048).astype(np.int64), np.rint(d * 2048).astype(np.int64))
    (a0, a1), (b0, b1) = share(dx), share(dy)
    line = lambda y: (q[y][:, x0] * a0[:, None] + q[y][:, x1] * a1[:, None]) >> 4
    return ((((b0[:, None, None] * line(y0)) >> 16) + ((b1[:, None, None] * line(y1)) >> 16) + 2) >> 2).astype(np.uint8)


def grown(v: np.ndarray, height: int, width: int) -> np.ndarray:
    (y0, y1, dy), (x0, x1, dx) = places(v.shape[0], height), places(v.shape[1], width)
    line = lambda y: v[y][:, x0] * (1 - dx) + v[y][:, x1] * dx
    return line(y0) * (1 - dy)[:, None] + line(y1) * dy[:, None]


def extreme(v: np.ndarray, radius: int, of: Callable) -> np.ndarray:
    """Least or greatest (`np.min`, `np.max`) of a square about each place; places outside do not count."""
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(v, pad, mode="edge")  # an end repeated adds no value to its window
        v = of(np.lib.stride_tricks.sliding_window_view(wide, 2 * radius + 1, axis=axis), axis=-1)
    return v


def mean_square(v: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Mean of a square about each place, mirrored at the border, by running sums."""
    for axis in (0, 1):
        wide = np.pad(v, [(radius + 1, radius) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        total = np.cumsum(wide, axis=axis)
        n = v.shape[axis]
        v = (np.take(total, np.arange(n) + 2 * radius + 1, axis=axis) - np.take(total, np.arange(n), axis=axis)) / (2 * radius + 1)
    return v


def guided(guide: np.ndarray, field: np.ndarray) -> np.ndarray:
    """The field smoothed along the guide: local lines of every second pixel, brought back to full size."""
    height, width = guide.shape
    rows, columns = (np.arange(n // 2) * n // (n // 2) for n in (height, width))
    g, s = guide[rows][:, columns] * 255.0, field[rows][:, columns] * 255.0
    mg, ms = mean_square(g), mean_square(s)
    a = (mean_square(g * s) - mg * ms) / (mean_square(g * g) - mg * mg + EPSILON)
    b = ms - a * mg
    return grown(mean_square(a), height, width) * guide + grown(mean_square(b) / 255, height, width)


def air(p: np.ndarray, guide: np.ndarray) -> np.ndarray:
    """Colour of the brightest pixel among those whose dark channel is in the top thousandth (of every fourth pixel both ways)."""
    dark = extreme(p.min(axis=2), min(p.shape[:2]) // SQUARE, np.min)
    seen = dark[::4, ::4]
    above = np.cumsum(np.bincount(seen.ravel(), minlength=256)[::-1])
    least = 255 - int(np.argmax(above >= int(seen.size * 0.001 + 1)))
    return p.reshape(-1, 3)[np.argmax(np.where(dark >= least, guide, 0))].astype(float)


def cleared(p: np.ndarray, light: np.ndarray, strength: float) -> np.ndarray:
    """The picture without the haze of an atmosphere's light."""
    height, width = p.shape[:2]
    small = shrunk(p, height // 4, width // 4)
    some = light > 0
    field = 1 - HAZE * strength * (small[..., some] / light[some]).min(axis=2) if some.any() else np.ones(small.shape[:2])
    field = guided(grey(small).astype(float), extreme(field, min(small.shape[:2]) // SQUARE, np.max))
    through = np.maximum(grown(field, height, width), LEAST)[..., None]
    return byte((p - light) / through + light)


def restored(df: DataFrame, by: list[str], order: str, clock: str, pixels: str, width: int, height: int, strength: float = 1.0, balance: float = 0.5, rate: float = RATE) -> DataFrame:
    """Rows (by, order, pixels) of the frames of each recording, restored.

    pixels: bytes r, g, b of width * height pixels, row by row; order: unique in a
    recording. A frame's power and light are mixed with those before it, `rate` of the old,
    and begin anew where the clock does not increase. A picture without green
    or blue, or all red, stays as it is and leaves the state alone; so does every picture
    at strength 0. Pixels that are null or of another size, and a null or infinite clock,
    give null pixels and leave the state alone. Pictures need 8 pixels each way.
    """
    if width < 8 or height < 8:
        raise ValueError("pictures need 8 pixels each way")
    keys = [*by, order]
    kinds = [df.schema[c] for c in keys]
    measure = StructField("__now", ArrayType(DoubleType()))

    def picture(cell, stamp) -> np.ndarray | None:
        if cell is None or len(cell) != width * height * 3 or stamp is None or not math.isfinite(stamp):
            return None
        return np.frombuffer(cell, np.uint8).reshape(height, width, 3)

    def balanced(p: np.ndarray) -> np.ndarray | None:
        found = gains(p, strength, balance) if strength else None
        return None if found is None else compensated(p, found)

    def powers(p: np.ndarray, _) -> list[float] | None:
        p = balanced(p)
        power = None if p is None else exponent(p)
        return None if power is None else [power]

    def bright(p: np.ndarray, power) -> np.ndarray | None:
        p = balanced(p)
        return None if p is None else brightened(p, power[0] if power else None, strength)

    def lights(p: np.ndarray, power) -> list[float] | None:
        p = bright(p, power)
        if p is None:
            return None
        small = shrunk(p, height // 4, width // 4)
        return air(small, grey(small)).tolist()

    def each(what: Callable, field: StructField, kept: list[StructField]):
        """`what` of each picture and of the state that stands beside it, of one picture at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.binary() if isinstance(field.dataType, BinaryType) else pa.list_(pa.float64())
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    value = lambda c, i=i, batch=batch: batch.column(c)[i].as_py()
                    p = picture(value("__pixels"), value("__clock"))
                    out.append(None if p is None else what(p, *[value(c) for c in ("__power", "__light") if c in batch.schema.names]))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(out, kind)], [*[f.name for f in kept], field.name])

        return run

    def finished(p: np.ndarray, power, light) -> bytes:
        made = bright(p, power)
        return (p if made is None else cleared(made, np.array(light), strength)).tobytes()

    def steadied(measures: DataFrame, name: str) -> DataFrame:
        """(keys, name): the measures of each recording mixed in order; a recording's are one stream, a few numbers a frame."""
        schema = StructType([*kinds, StructField(name, ArrayType(DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, state, last = object(), None, None
            for batch in batches:
                out = []
                columns = [batch.column(c).to_pylist() for c in (*by, "__clock", "__now")]
                for *own, stamp, now in zip(*columns, strict=True):
                    if own != key:
                        key, state, last = own, None, None
                    if stamp is not None and math.isfinite(stamp):
                        if last is not None and stamp <= last:
                            state = None
                        last = stamp
                        if now is not None:
                            state = now if not state or not any(state) else [rate * a + (1 - rate) * b for a, b in zip(state, now, strict=True)]
                    out.append(state)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(out, pa.list_(pa.float64()))], schema.names)

        dealt = measures.repartition(*by) if by else measures.coalesce(1)
        return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)

    def beside(rows: DataFrame, state: DataFrame) -> DataFrame:
        right = state.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(keys)], state.columns[-1])
        same = [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(keys)]
        condition = same[0]
        for s in same[1:]:
            condition &= s
        return rows.join(right, condition).select(*rows.columns, right.columns[-1])

    # A frame whose clock cannot be read takes no part; the mask keeps its key.
    rows = df.select(*keys, F.col(clock).cast("double").alias("__clock"), F.col(pixels).alias("__pixels"))
    scalars = [*kinds, StructField("__clock", DoubleType())]
    first = rows.mapInArrow(each(lambda p: powers(p, None), measure, scalars), StructType([*scalars, measure]))
    rows = beside(rows, steadied(first, "__power"))
    second = rows.mapInArrow(each(lights, measure, scalars), StructType([*scalars, measure]))
    rows = beside(rows, steadied(second, "__light"))
    result = StructField(pixels, BinaryType())
    return rows.mapInArrow(each(finished, result, kinds), StructType([*kinds, result]))
