"""Masks of a lens behind a housing: a circle, cut back where the housing's edge is nearer, feathered inwards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tidewell.operators.raster import STEP, distances

#: Fixed value: part of the circle's radius, along the rows of the turned picture, that is cut back (the cosine of 20 degrees in single precision).
BAND = 0.9396926164627075


def edge(angle: np.ndarray, boundary: Sequence[tuple[float, float]], outer: float) -> np.ndarray:
    """Squared radius of the edge at angles from the axis, in degrees: lines between the points, held before the first, the outer circle after the last."""
    at, squared = (np.array(c, float) for c in zip(*boundary, strict=True))
    return np.where(angle < at[-1], np.interp(angle, at, squared), outer) if len(at) > 1 else np.full(angle.shape, outer)


def housing_mask(width: int, height: int, centre: tuple[float, float], outer: float, boundary: Sequence[tuple[float, float]]) -> np.ndarray:
    """0 and 1 by rows and columns. outer and the boundary's radii are squared pixels.

    centre: (along, across) in the picture turned by a quarter, where `along` runs with the
    picture's rows. In each row of the band the pixels beyond the middle go, from the far side
    up to the first one that lies within the edge. The first and last columns are
    always empty, of a square picture the first row too.
    """
    radius = outer**0.5
    across, along = np.mgrid[0:width, 0:height]  # the turned picture: its rows are columns here
    x, y = int(centre[0]), int(centre[1])
    turned = (along - x) ** 2 + (across - y) ** 2 <= int(radius) ** 2
    dx, dy = along - centre[0], across - centre[1]
    within = dx * dx + dy * dy <= edge(np.degrees(np.arctan2(np.abs(dy), np.abs(dx))), boundary, outer)
    within[:, : height // 2 + 1] = True
    last = height - 1 - np.argmax(within[:, ::-1], axis=1)
    begin, end = (int(np.clip(centre[1] + s * BAND * radius, 0, width)) for s in (-1, 1))
    rows = np.arange(width)
    cut = (rows >= begin) & (rows < end)
    turned &= ~cut[:, None] | (along <= last[:, None])
    mask = turned[::-1].T.astype(np.uint8)
    if width == height:
        mask[0] = 0
    mask[:, [0, -1]] = 0
    return mask


def feathered(mask: np.ndarray, per_pixel: float) -> np.ndarray:
    """Weights that grow from the mask's zeros inwards, to 1 at most."""
    return np.minimum(distances(mask) / STEP * per_pixel, 1.0)
