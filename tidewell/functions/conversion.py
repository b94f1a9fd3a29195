"""Calibrations carried over to a sensor crop, and the scale between a lens's measured and physical radius.

A curve is an array of coefficients of the radius by the angle in degrees, the
constant first. A lens is a struct as `calibration.lens` gives it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.optics import bind
from tidewell.functions.rules import ruled

#: Fixed value: degrees between the sampled angles.
STEP = 0.1


def horner(coefficients: Column, at: Column) -> Column:
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda total, c: total * at + c)


def sphere_radius(theta: Column, xi: Column) -> Column:
    """Radius of the unified sphere model at an angle in radians, before distortion."""
    return F.sin(theta) / (F.cos(theta) + xi)


def distorted(u: Column, radial: Column) -> Column:
    """u + k1 u^3 + k2 u^5 + ... with five terms at most."""
    return u * horner(F.concat(F.array(F.lit(1.0)), F.slice(radial, 1, 5)), u * u)


def _positive(v: Column) -> Column:
    return F.when((v > 0) & (v < float("inf")), v)


def physical_scale(xi: Column, focal: Column, radial: Column, curve: Column, fov: Column) -> Column:
    """Pixels a unit of the physical radius, by least squares over half the field of view; null unless positive."""
    count = F.ceil(fov * 0.5 / STEP).cast("int")

    def sample(i: Column) -> Column:
        degrees = i * STEP
        return F.struct(horner(curve, degrees).alias("p"), (focal * distorted(sphere_radius(F.radians(degrees), xi), radial)).alias("q"))

    def added(total: Column, s: Column) -> Column:
        return F.struct((total["pp"] + s["p"] * s["p"]).alias("pp"), (total["pq"] + s["p"] * s["q"]).alias("pq"))

    samples = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), sample))
    return F.aggregate(samples, F.struct(F.lit(0.0).alias("pp"), F.lit(0.0).alias("pq")), added, lambda t: _positive(F.when(t["pp"] > 0, t["pq"] / t["pp"])))


def physical_scale_at_edge(xi: Column, focal: Column, radial: Column, curve: Column) -> Column:
    """The same from the angle of 90 degrees alone."""
    edge = horner(curve, F.lit(90.0))
    return _positive(F.when(edge != 0, distorted(1 / (xi + math.cos(math.pi / 2)), radial) * focal / edge))


def cropped(lenses: Column, canvas_w: Column, canvas_h: Column, version: Column, crop: Column) -> Column:
    """(changed, canvas_w, canvas_h, lenses, error) of a side-by-side calibration for a crop of the sensor.

    lenses: array of structs (fx, fy, cx, cy), one half of the canvas each; crop: struct as `rules.crop_window` gives.
    A calibration whose halves have the crop's size already, or a crop that is the whole sensor, changes nothing.
    """
    whole = (crop["sw"] == crop["dw"]) & (crop["sh"] == crop["dh"])
    half = F.floor(canvas_w / 2)
    none = crop.isNull() | (whole & (crop["x"] == 0) & (crop["y"] == 0))
    odd = canvas_w % 2 != 0
    done = none | (~odd & (half == crop["dw"]) & (canvas_h == crop["dh"]) & ~whole)
    flat = (crop["sw"] == 0) | (crop["sh"] == 0) | (crop["dw"] == 0) | (crop["dh"] == 0)
    breaches = [(flat, "crop_size"), (~none & odd, "odd_canvas"), (~done & (half * crop["sh"] != canvas_h * crop["sw"]), "aspect"), (~done & (version == 1), "version")]

    def moved(p: Column) -> Column:
        def lens(c: Column, i: Column) -> Column:
            cx = (c["cx"] - i * p["half"] + 0.5) * p["scale"] - 0.5 - p["left"] + i * p["width"]
            cy = (c["cy"] + 0.5) * p["scale"] - 0.5 - p["top"]
            return F.struct((c["fx"] * p["scale"]).alias("fx"), (c["fy"] * p["scale"]).alias("fy"), cx.alias("cx"), cy.alias("cy"))

        return F.transform(lenses, lens)

    changed = ~F.coalesce(done, F.lit(True))
    new = bind(moved, half=half, scale=crop["sw"] / half, left=(crop["sw"] - crop["dw"]) / 2 + crop["x"], top=(crop["sh"] - crop["dh"]) / 2 + crop["y"], width=crop["dw"])
    return ruled(breaches, changed=changed, canvas_w=F.when(changed, 2 * crop["dw"]).otherwise(canvas_w), canvas_h=F.when(changed, crop["dh"]).otherwise(canvas_h), lenses=F.when(changed, new).otherwise(lenses))
