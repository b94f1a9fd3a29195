"""Quaternions as structs (w, x, y, z) of doubles and vectors as structs (x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.optics import bind


def quaternion(w, x, y, z) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip("wxyz", (w, x, y, z), strict=True)])


def norm(q: Column) -> Column:
    """Length one, without overflow on the way; null where the length is zero or not finite."""
    n = F.hypot(F.hypot(q["w"], q["x"]), F.hypot(q["y"], q["z"]))
    return F.when((n > 0) & (n < float("inf")), quaternion(q["w"] / n, q["x"] / n, q["y"] / n, q["z"] / n))


def mul(a: Column, b: Column) -> Column:
    """Hamilton product."""
    return quaternion(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def inverse(q: Column) -> Column:
    """Of a unit quaternion."""
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def rotate(q: Column, v: Column) -> Column:
    """A vector turned by a unit quaternion, through the doubled cross product."""
    tx = 2 * (q["y"] * v["z"] - q["z"] * v["y"])
    ty = 2 * (q["z"] * v["x"] - q["x"] * v["z"])
    tz = 2 * (q["x"] * v["y"] - q["y"] * v["x"])
    return F.struct(
        (v["x"] + q["w"] * tx + q["y"] * tz - q["z"] * ty).alias("x"),
        (v["y"] + q["w"] * ty + q["z"] * tx - q["x"] * tz).alias("y"),
        (v["z"] + q["w"] * tz + q["x"] * ty - q["y"] * tx).alias("z"),
    )


def slerp(a: Column, b: Column, amount: Column) -> Column:
    """The shorter arc between unit quaternions; a straight line, made unit again, where they are near.

    The length of the line follows from the weights and the cosine, so the
    components need not be squared, which keeps the expression small.
    """
    t = F.least(F.greatest(amount, F.lit(0.0)), F.lit(1.0))
    dot = a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]
    cosine = F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(cosine)
    scale = F.when(cosine > 0.9995, F.sqrt(1 - 2 * t * (1 - t) * (1 - cosine))).otherwise(F.sin(angle))
    u = F.when(cosine > 0.9995, 1 - t).otherwise(F.sin((1 - t) * angle)) / scale
    v = F.when(cosine > 0.9995, t).otherwise(F.sin(t * angle)) / scale * F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return quaternion(*[a[c] * u + b[c] * v for c in "wxyz"])


def axis_angle(axis: Column, angle: Column) -> Column:
    """Turn about an axis; without an axis only the angle zero is one, anything else is null."""
    length = F.sqrt(axis["x"] * axis["x"] + axis["y"] * axis["y"] + axis["z"] * axis["z"])
    part = F.sin(angle / 2) / length
    return F.when(length > 1e-12, norm(quaternion(F.cos(angle / 2), axis["x"] * part, axis["y"] * part, axis["z"] * part))).when(F.abs(angle) <= 1e-12, quaternion(F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def euler(x: Column, y: Column, z: Column) -> Column:
    """Turns in degrees about the fixed axes X, then Y, then Z."""
    half = lambda c: F.radians(c) / 2
    none = F.lit(0.0)
    qx, qy, qz = quaternion(F.cos(half(x)), F.sin(half(x)), none, none), quaternion(F.cos(half(y)), none, F.sin(half(y)), none), quaternion(F.cos(half(z)), none, none, F.sin(half(z)))
    return bind(lambda t: bind(lambda u: mul(u["both"], u["x"]), both=mul(t["z"], t["y"]), x=t["x"]), x=qx, y=qy, z=qz)


def forward(q: Column) -> Column:
    """Where the axis Z points."""
    return F.struct((2 * (q["x"] * q["z"] + q["w"] * q["y"])).alias("x"), (2 * (q["y"] * q["z"] - q["w"] * q["x"])).alias("y"), (1 - 2 * (q["x"] * q["x"] + q["y"] * q["y"])).alias("z"))


def yaw(q: Column) -> Column:
    f = forward(q)
    return F.atan2(f["x"], f["z"])


def azimuth(q: Column) -> Column:
    """Direction of the turned axis X on the ground; null within about three degrees of the vertical."""
    x, y = 1 - 2 * (q["y"] * q["y"] + q["z"] * q["z"]), 2 * (q["x"] * q["y"] + q["w"] * q["z"])
    return F.when(F.sqrt(x * x + y * y) > 0.05, F.atan2(y, x))


def unwrap(angle: Column, near: Column) -> Column:
    """The angle a whole number of turns away that is nearest to another."""
    turn = 6.283185307179586
    return angle + F.round((near - angle) / turn) * turn


def gravity_correction(q: Column, acceleration: Column, gain: float = 0.5, tolerance: float = 0.15, innovation_degrees: float = 20.0) -> Column:
    """Body rate that tips the measured up towards the pose's; null where the reading is not gravity alone.

    The reading's length may be off one by the tolerance, its direction by the innovation angle.
    """
    length = F.sqrt(acceleration["x"] * acceleration["x"] + acceleration["y"] * acceleration["y"] + acceleration["z"] * acceleration["z"])
    a = [acceleration[c] / length for c in "xyz"]
    u = [2 * (q["x"] * q["z"] - q["w"] * q["y"]), 2 * (q["y"] * q["z"] + q["w"] * q["x"]), 1 - 2 * (q["x"] * q["x"] + q["y"] * q["y"])]
    cosine = a[0] * u[0] + a[1] * u[1] + a[2] * u[2]
    cross = [a[1] * u[2] - a[2] * u[1], a[2] * u[0] - a[0] * u[2], a[0] * u[1] - a[1] * u[0]]
    fine = (F.abs(length - 1) <= tolerance) & (cosine >= F.cos(F.radians(F.lit(innovation_degrees))))
    return F.when(fine, F.struct(*[(gain * c).alias(n) for c, n in zip(cross, "xyz", strict=True)]))
