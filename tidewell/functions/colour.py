"""Colour look-ups, colour spaces and underwater compensation as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.optics import bind

#: Linear RGB to XYZ over the white point, and back.
TO_XYZ = ((0.433953, 0.376219, 0.189828), (0.212671, 0.715160, 0.072169), (0.017758, 0.109477, 0.872765))
FROM_XYZ = ((3.0799327, -1.537150, -0.542782), (-0.921235, 1.875992, 0.0452442), (0.0528909, -0.204043, 1.1511515))


def grid(values: Sequence[float], kind: str = "double") -> Column:
    """A constant array; one literal after constant folding, whatever its length."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def lut_trilinear(r: Column, g: Column, b: Column, table: Column, size: int, low: float = 0.0, high: float = 1.0) -> Column:
    """One channel of a cube look-up, red fastest; inputs are clamped and NaN counts as the least."""
    edge = size - 1
    place = lambda c: (clamp(F.when(F.isnan(c), low).otherwise(c), low, high) - low) / (high - low) * edge
    at = [place(c) for c in (r, g, b)]
    lower = [F.floor(p).cast("int") for p in at]
    upper = [F.least(c + 1, F.lit(edge)) for c in lower]
    fraction = [p - c for p, c in zip(at, lower, strict=True)]
    pick = lambda i, j, k: F.get(table, i + size * (j + size * k))
    mix = lambda a, c, t: a + (c - a) * t
    face = lambda k: mix(*[mix(pick(lower[0], j, k), pick(upper[0], j, k), fraction[0]) for j in (lower[1], upper[1])], fraction[1])
    return mix(face(lower[2]), face(upper[2]), fraction[2])


def lut_tetrahedral(rgb: Sequence[Column], table: Column, step: int, edge: int) -> Column:
    """One channel of a byte look-up, the last axis fastest: the walk to the far corner takes the axes by falling fraction.

    A tie of the first two goes by the strict comparisons of the order below.
    The sum of the walk is divided by the step towards zero.
    """
    base = F.array(*[F.floor(c / step).cast("int") for c in rgb])
    x, y, z = part = [(c % step).cast("int") for c in rgb]
    order = F.when((x > y) & (y > z), "012").when((x > y) & (x > z), "021").when(x > y, "201").when(x > z, "102").when(y > z, "120").otherwise("210")

    def walk(p: Column) -> Column:
        strides = (edge * edge, edge, 1)
        # One step along an axis, none from the last cell.
        steps = F.array(*[F.when(p["base"][i] < edge - 1, s).otherwise(0) for i, s in enumerate(strides)])
        first, second = (F.substring(p["order"], i, 1).cast("int") for i in (1, 2))
        start = sum((p["base"][i] * s for i, s in enumerate(strides[1:], 1)), p["base"][0] * strides[0])
        return bind(corners, part=p["part"], axes=F.array(first, second, 3 - first - second), steps=steps, start=start)

    def corners(p: Column) -> Column:
        along = [F.get(p["steps"], p["axes"][i]) for i in range(3)]
        places = [p["start"], p["start"] + along[0], p["start"] + along[0] + along[1], p["start"] + along[0] + along[1] + along[2]]
        return bind(total, values=F.array(*[F.get(table, c) for c in places]), parts=F.array(*[F.get(p["part"], p["axes"][i]) for i in range(3)]))

    def total(p: Column) -> Column:
        v = p["values"]
        return bind(lambda q: clamp(q["first"] + F.signum(q["sum"].cast("double")).cast("int") * F.floor(F.abs(q["sum"]) / step).cast("int"), 0, 255), first=v[0], sum=sum(((v[i + 1] - v[i]) * p["parts"][i] for i in (1, 2)), (v[1] - v[0]) * p["parts"][0]))

    return bind(walk, base=base, part=F.array(*part), order=order)


def _lab(t: Column) -> Column:
    return F.when(t > (6 / 29) ** 3, F.pow(F.greatest(t, F.lit(0.0)), F.lit(1 / 3))).otherwise(t * (29 / 6) ** 2 / 3 + 4 / 29)


def _unlab(t: Column) -> Column:
    return F.when(t > 6 / 29, t * t * t).otherwise((t - 4 / 29) * 3 * (6 / 29) ** 2)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    x, y, z = (_lab(m[0] * r + m[1] * g + m[2] * b) for m in TO_XYZ)
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def lab_to_rgb(lab: Column) -> Column:
    y = (lab["l"] + 16) / 116
    xyz = [_unlab(c) for c in (y + lab["a"] / 500, y, y - lab["b"] / 200)]
    return F.struct(*[sum((xyz[i] * m[i] for i in (1, 2)), xyz[0] * m[0]).alias(n) for m, n in zip(FROM_XYZ, "rgb", strict=True)])


def lut_blend(plain: Column, looked_up: Column, strength: Column) -> Column:
    """Byte between both, ties to even."""
    return clamp(F.rint(plain + (looked_up - plain) * strength), 0, 255).cast("int")


def dehaze(pixel: Column, air: Column, transmission: Column) -> Column:
    """(p - A) / max(t, 0.3) + A as a byte, ties to even."""
    return clamp(F.rint((pixel - air) / F.greatest(transmission, F.lit(0.3)) + air), 0, 255).cast("int")


def compensation(red: Column, green: Column, blue: Column, strength: float = 1.0, balance: float = 0.5) -> Column:
    """Gains (other, from_blue, from_green) out of a picture's channel means; null where it is left as it is."""
    tilt = 2 * (balance - 0.5)
    strong, weak = F.greatest(green, blue), F.least(green, blue)
    amount = F.when(green >= blue, 0.6 * strength).otherwise(0.3 * strength)
    lead = lambda v: F.when(v > 60, v).otherwise(F.greatest(1.5 * (v - 20), F.lit(0.0)))
    other = F.when(strong == weak, 0.0).otherwise((strong - weak) * amount / (255 - weak) / strong)
    gains = F.struct(other.alias("other"), (lead(blue - red) * ((tilt - 1) * strength) / (255 - red) / blue).alias("from_blue"), (lead(green - red) * ((2 - tilt) * strength) / (255 - red) / green).alias("from_green"))
    return F.when((green >= 0.1) & (blue >= 0.1) & (red <= 254), gains)


def strength_mix(source: Column, restored: Column, luminance: Column, strength: Column) -> Column:
    """A restored colour that keeps part of the source's lightness, then part of the source: structs (r, g, b) of 0 to 1."""

    def mixed(p: Column) -> Column:
        lightness = p["s"]["l"] + (p["t"]["l"] - p["s"]["l"]) * luminance
        return bind(lambda q: F.struct(*[(source[c] + (q["rgb"][c] - source[c]) * strength).alias(c) for c in "rgb"]), rgb=lab_to_rgb(p["t"].withField("l", lightness)))

    return bind(mixed, s=rgb_to_lab(source["r"], source["g"], source["b"]), t=rgb_to_lab(restored["r"], restored["g"], restored["b"]))


#: Mean and deviation of the channels that image networks are trained with.
CHANNEL_MEAN, CHANNEL_DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def network_input(r: Column, g: Column, b: Column, normal: bool = True) -> Column:
    """Bytes as (r, g, b) of a network's input: less the mean by the deviation, or 0 to 1."""
    scaled = lambda c, m, d: c / (255 * d) - m / d if normal else c / 255
    return F.struct(*[scaled(c, m, d).alias(n) for c, m, d, n in zip((r, g, b), CHANNEL_MEAN, CHANNEL_DEVIATION, "rgb", strict=True)])
