"""Camera motion as column expressions: corrections, target attitudes, read-out poses, axes and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import quaternion as quat
from tidewell.functions.optics import bind

OFF, LOCK, FOLLOW = "off", "lock", "follow"
#: Poses of a read-out table, and the least cosine of half the turn between neighbours (90 degrees).
POSES, LEAST_COSINE = 129, 0.5**0.5
#: Directions in which a sensor is read: (axis of the picture, whether from its end).
DIRECTIONS = {"down": ("y", False), "up": ("y", True), "right": ("x", False), "left": ("x", True)}


def identity() -> Column:
    return quat.quaternion(F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def about(axis: str, angle: Column) -> Column:
    """Turn about one of the axes x, y, z."""
    parts = {"w": F.cos(angle / 2), axis: F.sin(angle / 2)}
    return quat.quaternion(*[parts.get(c, F.lit(0.0)) for c in "wxyz"])


def correction(mode: Column, pose: Column, anchor: Column) -> Column:
    """Rotation of camera rays that steadies a pose: none, towards an anchor, or towards the pose's own heading about Y; null for other modes."""
    back = quat.inverse(pose)
    return F.when(mode == OFF, identity()).when(mode == LOCK, quat.mul(anchor, back)).when(mode == FOLLOW, quat.mul(about("y", quat.yaw(pose)), back))


def target(mode: Column, pose: Column, heading: Column) -> Column:
    """Attitude wanted of the picture: the pose itself, level, or level with the heading about Z; null without a pose, and for other modes."""
    return F.when(pose.isNotNull(), F.when(mode == OFF, pose).when(mode == LOCK, identity()).when(mode == FOLLOW, about("z", heading)))


def relative(pose: Column, reference: Column) -> Column:
    """Turn from a reference pose to a pose, seen from the camera."""
    return quat.mul(quat.inverse(pose), reference)


def table_status(poses: Column, low: Column, high: Column) -> Column:
    """The first reason why poses are no read-out table over the interval low to high of the sensor, or `ok`."""
    n = F.size(poses)
    near = F.zip_with(F.slice(poses, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(poses, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]) >= LEAST_COSINE)
    fine = (low >= 0) & (high <= 1) & (low < high)
    return F.when(~F.coalesce(n.between(2, POSES), F.lit(False)), "count").when(~F.coalesce(fine, F.lit(False)), "interval").when(~F.forall(near, lambda ok: F.coalesce(ok, F.lit(False))), "step").otherwise("ok")


def uniform_pose(poses: Column, fraction: Column) -> Column:
    """Pose at a fraction of a table's even steps; its ends are held."""

    def found(p: Column) -> Column:
        return quat.slerp(F.get(p["poses"], p["at"]), F.get(p["poses"], p["at"] + 1), p["place"] - p["at"])

    def placed(p: Column) -> Column:
        return bind(found, poses=p["poses"], place=p["place"], at=F.least(F.floor(p["place"]).cast("int"), F.size(p["poses"]) - 2))

    return bind(placed, poses=poses, place=F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * (F.size(poses) - 1))


def readout_fraction(direction: Column, x: Column, y: Column, width: Column, height: Column, low: Column, high: Column) -> Column:
    """When a pixel is read, as a fraction of the whole sensor's time; low, high: the interval of the sensor that the picture shows."""
    share = lambda at, size: F.least(F.greatest((at + 0.5) / size, F.lit(0.0)), F.lit(1.0))
    axes = {"x": low + share(x, width) * (high - low), "y": low + share(y, height) * (high - low)}
    out = F
    for name, (axis, turned) in DIRECTIONS.items():
        out = out.when(direction == name, 1 - axes[axis] if turned else axes[axis])
    return out


def readout_pose(poses: Column, direction: Column, x: Column, y: Column, width: Column, height: Column, low: Column, high: Column) -> Column:
    return uniform_pose(poses, readout_fraction(direction, x, y, width, height, low, high))


def readout_offsets(seconds: Column) -> Column:
    """Microseconds of a table's poses before and after the centre of a frame."""
    return F.transform(F.sequence(F.lit(0), F.lit(POSES - 1)), lambda i: (i / (POSES - 1) - 0.5) * seconds * 1e6)


def body_axes(v: Column) -> Column:
    """A raw reading in the camera's own axes, or null where a part is not a number: (y, z, x)."""
    fine = F.lit(True)
    for c in "xyz":
        fine = fine & F.coalesce(F.abs(v[c]) < float("inf"), F.lit(False))
    return F.when(fine, F.struct(v["y"].alias("x"), v["z"].alias("y"), v["x"].alias("z")))


def all_in_body_axes(samples: Column) -> Column:
    """Array of readings in the camera's axes; null as a whole where one of them is no reading, so none is turned twice."""
    turned = F.transform(samples, body_axes)
    return F.when(~F.exists(turned, lambda v: v.isNull()), turned)


def elapsed(pts: Column, start: Column, numerator: Column, denominator: Column) -> Column:
    """Nanoseconds since the start of a stream, rounded down; null before it, and without a time base."""
    whole = (pts.cast("decimal(20,0)") - start.cast("decimal(20,0)")).cast("decimal(38,0)") * numerator.cast("decimal(10,0)")
    base = denominator.cast("decimal(10,0)")
    # Whole seconds and the rest apart, so that no product needs more than 38 digits.
    nanos = F.call_function("div", whole, base).cast("decimal(38,0)") * 1_000_000_000 + F.call_function("div", whole % base * 1_000_000_000, base)
    return F.when((pts >= start) & (numerator > 0) & (denominator > 0), nanos.cast("decimal(38,0)"))
