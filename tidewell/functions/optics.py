"""Projections and colour arithmetic as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(use: Callable[[Column], Column], **values: Column) -> Column:
    """`use` of a struct of the values, each worked out once however often it is used."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use), 1)


def panorama_ray(x: Column, y: Column, width: int, height: int) -> Column:
    """Unit ray through a pixel centre of an equirectangular picture: 2 pi around, pi up and down."""
    lon = ((x + 0.5) / width - 0.5) * 2 * math.pi
    lat = (0.5 - (y + 0.5) / height) * math.pi
    return F.struct((F.cos(lat) * F.sin(lon)).alias("x"), F.sin(lat).alias("y"), (F.cos(lat) * F.cos(lon)).alias("z"))


def omni_project(ray: Column, xi: float, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Unified sphere model: the ray from a point xi behind the sphere's centre; null behind the camera."""
    depth = ray["z"] + xi * F.sqrt(ray["x"] ** 2 + ray["y"] ** 2 + ray["z"] ** 2)
    return F.when(depth > 0, F.struct((fx * ray["x"] / depth + cx).alias("u"), (fy * ray["y"] / depth + cy).alias("v")))


def poly_radius(theta: Column, coefficients: list[float]) -> Column:
    """theta * (c0 + c1 theta + c2 theta^2 + ...), by Horner's rule."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * theta + c
    return out * theta


def yuv_to_rgb(y: Column, u: Column, v: Column, kr: float = 0.2126, kb: float = 0.0722, limited: bool = True) -> Column:
    """Eight-bit YUV to RGB of the matrix with red and blue weights kr and kb, clamped to 0..255."""
    luma = (y - 16) * (255 / 219) if limited else y * 1.0
    scale = 255 / 224 if limited else 1.0
    cb, cr, kg = (u - 128) * scale, (v - 128) * scale, 1 - kr - kb
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))
    return F.struct(clamp(luma + 2 * (1 - kr) * cr).alias("r"), clamp(luma - 2 * kb * (1 - kb) / kg * cb - 2 * kr * (1 - kr) / kg * cr).alias("g"), clamp(luma + 2 * (1 - kb) * cb).alias("b"))


def grey(r: Column, g: Column, b: Column) -> Column:
    """Integer luma with 15 fractional bits, rounded."""
    return F.shiftright(9798 * r + 19235 * g + 3735 * b + (1 << 14), 15)


def overlap_alpha(distance: Column, belt: float) -> Column:
    """Weight over a seam: a ramp of the belt's width; without a belt a hard edge, one half on it."""
    if belt <= 1e-6:
        return F.when(distance > 1e-6, 1.0).when(distance < -1e-6, 0.0).otherwise(0.5)
    return F.least(F.greatest(distance / belt + 0.5, F.lit(0.0)), F.lit(1.0))


def sharpen_alpha(alpha: Column, power: float = 5.2) -> Column:
    """A weight drawn towards 0 and 1, symmetric about one half."""
    low = 0.5 * F.pow(2 * F.least(alpha, F.lit(0.5)), F.lit(power))
    high = 1 - 0.5 * F.pow(2 * (1 - F.greatest(alpha, F.lit(0.5))), F.lit(power))
    return F.when(alpha <= 0.5, low).otherwise(high)


def blend_weights(ray: Column, blend_degrees: float, fov_degrees: float) -> Column:
    """(detail, illumination) of one of two opposed lenses; null for a ray of no length."""
    length = F.sqrt(ray["x"] * ray["x"] + ray["y"] * ray["y"] + ray["z"] * ray["z"])
    distance = math.pi / 2 - F.acos(F.least(F.greatest(ray["z"] / length, F.lit(-1.0)), F.lit(1.0)))
    detail = sharpen_alpha(overlap_alpha(distance, math.radians(blend_degrees) - math.pi))
    return F.when(length > 2.220446049250313e-16, F.struct(detail.alias("detail"), overlap_alpha(distance, math.radians(fov_degrees) - math.pi).alias("illumination")))


def radtan(x: Column, y: Column, k: list[float]) -> Column:
    """Radial and tangential distortion: k1, k2, k3, p1, p2."""
    k1, k2, k3, p1, p2 = k
    r2, xy = x * x + y * y, x * y
    scale = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return F.struct((x * scale + 2 * p1 * xy + p2 * (r2 + 2 * x * x)).alias("x"), (y * scale + 2 * p2 * xy + p1 * (r2 + 2 * y * y)).alias("y"))


def radtan_pro(x: Column, y: Column, k: list[float]) -> Column:
    """The same with five radial, four tangential and four thin-prism terms: k1..k5, p1..p4, s1..s4."""
    radial, (p1, p2, p3, p4), (s1, s2, s3, s4) = k[:5], k[5:9], k[9:]
    r2, xy = x * x + y * y, x * y
    scale = F.lit(0.0)
    for c in reversed(radial):
        scale = (scale + c) * r2
    scale, first, second = scale + 1, p1 + p3 * r2, p2 + p4 * r2
    return F.struct((x * scale + first * (r2 + 2 * x * x) + 2 * second * xy + r2 * (s1 + s3 * r2)).alias("x"), (y * scale + second * (r2 + 2 * y * y) + 2 * first * xy + r2 * (s2 + s4 * r2)).alias("y"))


def omni_distorted(ray: Column, xi: float, distortion: list[float], fx: float, fy: float, cx: float, cy: float, within: float | None = None) -> Column:
    """Unified sphere model with 5 or 13 distortion terms; null where the projection does not exist, or lies `within` or farther from the axis before distortion."""
    bent = radtan if len(distortion) == 5 else radtan_pro

    def seen(p: Column) -> Column:
        inside = F.lit(True) if within is None else p["x"] * p["x"] + p["y"] * p["y"] < within * within
        return bind(lambda q: F.when(inside, F.struct((q["p"]["x"] * fx + cx).alias("u"), (q["p"]["y"] * fy + cy).alias("v"))), p=bent(p["x"], p["y"], distortion))

    def flat(r: Column) -> Column:
        return F.when(F.abs(r["depth"]) > 2.220446049250313e-16, bind(seen, x=r["ray"]["x"] / r["depth"], y=r["ray"]["y"] / r["depth"]))

    def deep(r: Column) -> Column:
        r = r["ray"]
        return bind(flat, ray=r, depth=r["z"] + xi * F.sqrt(r["x"] * r["x"] + r["y"] * r["y"] + r["z"] * r["z"]))

    return bind(deep, ray=ray)


def radial_project(ray: Column, radius: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """A ray drawn at a given radius in its own direction; the centre where it lies on the axis."""
    across = F.sqrt(ray["x"] * ray["x"] + ray["y"] * ray["y"])
    on_axis = across <= 2.220446049250313e-16
    side = lambda c: F.when(on_axis, 0.0).otherwise(radius * ray[c] / across)
    return F.struct((cx + fx * side("x")).alias("u"), (cy + fy * side("y")).alias("v"))


def poly_project(ray: Column, coefficients: list[float], fx: float, fy: float, cx: float, cy: float) -> Column:
    """Fisheye whose radius is a polynomial of the angle to the axis."""
    theta = F.atan2(F.sqrt(ray["x"] * ray["x"] + ray["y"] * ray["y"]), ray["z"])
    return radial_project(ray, poly_radius(theta, coefficients), fx, fy, cx, cy)


def equidistant_project(ray: Column, k: list[float], fx: float, fy: float, cx: float, cy: float) -> Column:
    """Fisheye with an odd polynomial of the angle, rows growing downwards; null where the radius is negative."""
    theta = F.acos(F.least(F.greatest(ray["z"], F.lit(-1.0)), F.lit(1.0)))
    t2 = theta * theta
    radius = theta * (1 + t2 * (k[0] + t2 * (k[1] + t2 * k[2])))
    return F.when(radius >= 0, radial_project(ray, radius, fx, -fy, cx, cy))


def inside_fov(ray: Column, degrees: float) -> Column:
    """Whether the angle to the lens axis lies in half the field of view."""
    length = F.sqrt(ray["x"] * ray["x"] + ray["y"] * ray["y"] + ray["z"] * ray["z"])
    return F.acos(F.least(F.greatest(ray["z"] / length, F.lit(-1.0)), F.lit(1.0))) <= math.radians(degrees / 2)


def to_source(x: Column, y: Column, lens: int, canvas: tuple[int, int], frame: tuple[int, int]) -> tuple[Column, Column]:
    """Calibration pixels of a side-by-side canvas as pixels of one lens's frame."""
    half = canvas[0] / 2
    return (x - half * lens) * (frame[0] / half), y * (frame[1] / canvas[1])


def knots(at: Column, points: list[tuple[float, float]], beyond: float) -> Column:
    """Straight lines between (place, value) knots, held before the first; `beyond` after the last."""
    out = F
    for (a, v), (b, w) in zip(points, points[1:], strict=False):
        out = out.when(at < b, v + (w - v) * F.least(F.greatest((at - a) / (b - a), F.lit(0.0)), F.lit(1.0)))
    return out.otherwise(beyond)


def ramp_gain(slope: Column, row: Column, height: int, dead_zone: float, second: bool) -> Column:
    """Gain that grows along the rows beyond a dead zone, from the far end for the second lens; never negative."""
    row = F.least(F.greatest(row, F.lit(0.0)), F.lit(float(height - 1)))
    past = F.greatest((height - 1 - row if second else row) - dead_zone, F.lit(0.0))
    return F.greatest(1 + slope * past, F.lit(0.0))


def smoothstep(v: Column) -> Column:
    return v * v * (3 - 2 * v)


def quality_bitrate(width: Column, height: Column, fps: Column, quality: Column) -> Column:
    """Bits a second for a quality of 1 to 100: less than in proportion to pixels, steep in quality."""
    pixels = 1920.0 * 960.0  # fixed value: the reference picture
    grown = F.pow(width * height / pixels, F.lit(0.62))
    q = quality / 100.0
    return F.greatest(F.round(pixels * fps * grown * (0.02 + 1.2 * q * q * q * q)), F.lit(100_000.0)).cast("long")
