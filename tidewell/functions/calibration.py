"""Lens calibrations written as `_`-separated numbers: parsing, checking and writing them as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import quaternion as quat

#: Numbers of one lens record by version, and names of the version 2, 3 and 6 fields before and after the distortion terms.
RECORD = {1: 6, 2: 16, 3: 19, 6: 27}
DISTORTION = {1: 0, 2: 4, 3: 5, 6: 13}
#: Fixed value: candidates are tried in this order.
PRIORITY = (6, 3, 2, 1)


def plausible(text: Column) -> Column:
    """Two lenses, then only what numbers are made of."""
    return F.coalesce(F.rlike(text, F.lit(r"^2_[0-9_.+\-eE]*$")), F.lit(False))


def numbers(text: Column) -> Column:
    """The fields as doubles; a field that is no number is null."""
    clean = F.regexp_replace(text, "^[\\s\\u0000]+|[\\s\\u0000]+$", "")
    return F.transform(F.split(clean, "_"), lambda v: v.try_cast("double"))


def status(text: Column, version: int) -> Column:
    """ok, or the first rule a calibration of a version breaks."""
    n, per = numbers(text), RECORD[version]
    fields = 1 + 2 * per + (3 if version == 1 else 1)
    whole = lambda c: c == F.floor(c)
    size = [F.get(n, i) for i in ((13, 14) if version == 1 else (per - 2, per - 1, 2 * per - 2, 2 * per - 1))]
    sized = F.lit(True)
    for c in size:
        sized = sized & (c > 0) & whole(c) & (c < 2**32)
    out = F.when(text.isNull() | (F.length(text) == 0), "empty").when(F.coalesce(F.get(n, 0), F.lit(-1.0)) != 2, "lens_count").when(F.size(n) != fields, "field_count")
    out = out.when(F.exists(n, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "not_a_number").when(~sized, "canvas")
    if version > 1:
        out = out.when((size[0] != size[2]) | (size[1] != size[3]), "canvas_differs").when(F.floor(F.get(n, 2 * per + 1) / 65536) != version, "version_word")
    return out.otherwise("ok")


def lens(text: Column, version: int, index: int) -> Column:
    """One lens: xi (null before version 3), focal lengths, centre, Euler angles in degrees, translation, distortion terms, canvas and type.

    Version 1 has one radius for both focal lengths, and one canvas for both lenses
    whose last word holds the type in its low ten bits.
    """
    n, per = numbers(text), RECORD[version]
    at = lambda i: F.get(n, 1 + index * per + i)
    tail = lambda i: F.get(n, 1 + 2 * per + i)
    omni, k = version >= 3, 5 if version >= 3 else 3
    lone = version == 1
    after = k + 6 + DISTORTION[version]
    flat = F.array(*[F.lit(0.0)] * 3)
    centre = (3, 4) if omni else (1, 2)
    parts = {
        "xi": at(0) if omni else F.lit(None).cast("double"), "fx": at(1) if omni else at(0), "fy": at(2) if omni else at(0), "cx": at(centre[0]), "cy": at(centre[1]),
        "euler": F.array(at(k), at(k + 1), at(k + 2)), "translation": flat if lone else F.array(*[at(k + 3 + i) for i in range(3)]),
        "distortion": F.array(*[at(k + 6 + i) for i in range(DISTORTION[version])]).cast("array<double>") if not lone else F.array().cast("array<double>"),
        "canvas_w": (tail(0) if lone else at(after)).cast("int"), "canvas_h": (tail(1) if lone else at(after + 1)).cast("int"),
        "lens_type": tail(2).cast("int").bitwiseAND(1023) if lone else at(after + 2).cast("int"),
    }
    return F.struct(*[c.alias(name) for name, c in parts.items()])


def orientation(lens_: Column) -> Column:
    """Pose of a lens; the second angle counts from a quarter turn."""
    e = lens_["euler"]
    return quat.euler(F.get(e, 0), F.get(e, 1) + 90, F.get(e, 2))


def encode(fields: Column) -> Column:
    """Numbers joined as they are written, whole ones without a point."""
    return F.array_join(F.transform(fields, lambda v: F.when(v == F.floor(v), v.cast("decimal(20,0)").cast("string")).otherwise(v.cast("string"))), "_")


def blend_angle(recorded: Column, fallback: Column) -> Column:
    """A recorded angle of 180 to 360 degrees before the profile's; none is 0 or null, any other gives null."""
    return F.when(F.coalesce(recorded, F.lit(0)) == 0, fallback.cast("double")).when(recorded.between(180, 360), recorded.cast("double"))


def polynomial(b: list[float], full_fov: float) -> tuple[list[float], float]:
    """(coefficients of the angle in radians, scale of the focal length) of a radius polynomial in degrees b0..b4; b0 does not count."""
    k, half = 180 / math.pi, full_fov / 2
    at_edge = half * (b[1] + half * (b[2] + half * (b[3] + half * b[4])))
    if not (math.isfinite(b[1]) and b[1] > 0 and math.isfinite(at_edge) and at_edge > 0):
        raise ValueError("radius polynomial")
    return [1.0, *[b[i] * k ** (i - 1) / b[1] for i in (2, 3, 4)]], b[1] * k / at_edge


def pick(offsets: dict[int, Column]) -> Column:
    """(version, text) of the newest calibration that reads, by the fixed priority; null if none does."""
    tried = [F.when(status(offsets[v], v) == "ok", F.struct(F.lit(v).alias("version"), offsets[v].alias("text"))) for v in PRIORITY if v in offsets]
    return F.coalesce(*tried)
