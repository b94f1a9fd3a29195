"""Rays moved by a field of shifts over the belt in which two lenses overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import quaternion as quat
from tidewell.functions.optics import bind
from tidewell.operators.raster import displacement_sample


def plan_direction(ray: Column, basis: Column, half_height: float, dx: Column, dy: Column, width: int, height: int) -> Column:
    """The second lens's ray: turned by a field (row by row, width round the basis' axis Z) of final shifts in cells.

    The belt reaches half_height radians to both sides of the basis' equator; rays
    outside it, and where the field is zero, stay as they are.
    """

    def around(p: Column) -> Column:
        across = F.sqrt(p["l"]["x"] * p["l"]["x"] + p["l"]["y"] * p["l"]["y"])
        return bind(shifted, theta=F.atan2(across, p["l"]["z"]), phi=F.atan2(p["l"]["y"], p["l"]["x"]))

    def shifted(p: Column) -> Column:
        latitude = p["theta"] - math.pi / 2
        x = p["phi"] / (2 * math.pi) * width - 0.5
        y = (latitude / half_height + 1) * 0.5 * height - 0.5
        inside = F.abs(latitude) < half_height
        return bind(turned, theta=p["theta"], phi=p["phi"], by=F.when(inside, displacement_sample(dx, dy, x, y, width, height)))

    def turned(p: Column) -> Column:
        moved = F.coalesce((p["by"]["dx"] != 0) | (p["by"]["dy"] != 0), F.lit(False))
        return F.when(moved, bind(back, theta=p["theta"] + p["by"]["dy"] * 2 * half_height / height, phi=p["phi"] + p["by"]["dx"] * 2 * math.pi / width)).otherwise(ray)

    def back(p: Column) -> Column:
        local = F.struct((F.sin(p["theta"]) * F.cos(p["phi"])).alias("x"), (F.sin(p["theta"]) * F.sin(p["phi"])).alias("y"), F.cos(p["theta"]).alias("z"))
        return quat.rotate(quat.inverse(basis), local)

    return bind(around, l=quat.rotate(basis, ray))
