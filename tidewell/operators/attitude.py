"""Attitude from motion samples: integration dealt by clock cells, and gravity fusion of whole recordings."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import quaternion as quat


def _mul(a, b):
    w, x, y, z = a
    s, u, v, t = b
    out = np.array([w * s - x * u - y * v - z * t, w * u + x * s + y * t - z * v, w * v - x * t + y * s + z * u, w * t + x * v - y * u + z * s])
    return out / np.sqrt(out @ out)


def _turn(omega, seconds: float):
    speed = math.sqrt(omega @ omega)
    if speed <= 1e-12:
        return np.array([1.0, 0, 0, 0])
    half = speed * seconds / 2
    return np.concatenate([[math.cos(half)], omega * (math.sin(half) / speed)])


def _rotate(q, v):
    t = 2 * np.cross(q[1:], v)
    return v + q[0] * t + np.cross(q[1:], t)


def integrate(df: DataFrame, by: list[str], clock: str, gyro: str, cell: int, per_second: int = 1_000_000) -> DataFrame:
    """(by, clock, q): the product of the small turns since each key's first sample, rates taken at the mid-point.

    The product is associative, so each clock cell of a key is folded by itself and
    the cells' totals, one row each, are folded after that: a long recording is
    many tasks. Intervals of a quarter turn or more are cut into equal steps.
    """
    cells = df.select(*by, clock, gyro).withColumn("__cell", F.floor(F.col(clock) / cell))
    local = Window.partitionBy(*by, "__cell").orderBy(clock)
    edges = cells.groupBy(*by, "__cell").agg(F.max(F.struct(clock, gyro)).alias("__last"))
    edges = edges.withColumn("__before", F.lag("__last").over(Window.partitionBy(*by).orderBy("__cell"))).drop("__last")
    rows = cells.withColumn("__p", F.lag(F.struct(clock, gyro)).over(local)).join(edges, [*by, "__cell"])
    rows = rows.select(*by, "__cell", clock, gyro, F.coalesce("__p", "__before").alias("__p")).select(*by, "__cell", clock, gyro, F.col(f"__p.{clock}").alias("__t"), F.col(f"__p.{gyro}").alias("__g"))
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    kind = df.schema[clock].dataType.simpleString()

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(clock)
        q, out = np.array([1.0, 0, 0, 0]), []
        for t, g, t0, g0 in zip(part[clock], part[gyro], part["__t"], part["__g"], strict=True):
            if g0 is not None:
                a, b = np.asarray(g0, float), np.asarray(g, float)
                seconds = (t - t0) / per_second
                n = max(1, math.ceil(max(math.sqrt(a @ a), math.sqrt(b @ b)) * seconds / (math.pi / 2)))
                for i in range(n):
                    q = _mul(q, _turn(a + (b - a) * ((i + 0.5) / n), seconds / n))
            out.append(q.tolist())
        return part[[*by, "__cell", clock]].assign(__q=out)

    turned = rows.groupBy(*by, "__cell").applyInPandas(fold, f"{keys}, __cell long, {clock} {kind}, __q array<double>")
    totals = turned.groupBy(*by, "__cell").agg(F.max_by("__q", clock).alias("__q"))

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__cell")
        q, out = np.array([1.0, 0, 0, 0]), []
        for total in part["__q"]:
            out.append(q.tolist())
            q = _mul(q, np.asarray(total))
        return part[[*by, "__cell"]].assign(__start=out)

    starts = totals.groupBy(*by).applyInPandas(chain, f"{keys}, __cell long, __start array<double>")
    pose = lambda c: quat.quaternion(*[F.element_at(c, i) for i in range(1, 5)])
    return turned.join(starts, [*by, "__cell"]).select(*by, clock, quat.mul(pose("__start"), pose("__q")).alias("q"))


@dataclass(frozen=True)
class Fusion:
    """Gates and gains of gravity fusion, in g, radians and seconds."""

    gain: float = 0.5
    tolerance: float = 0.15
    innovation: float = math.radians(20)
    window: float = 0.25
    least_window: float = 0.02
    gap: float = 0.1
    max_speed: float = math.radians(2000)
    coherent: float = math.radians(5)
    step_seconds: float = 0.01
    step_angle: float = 0.1
    still_speed: float = math.radians(0.2)


UP = np.array([0.0, 0, 1])


def _unit(a, o: Fusion):
    n = math.sqrt(a @ a)
    return a / n if math.isfinite(n) and abs(n - 1) <= o.tolerance else None


def _azimuth(q):
    x = _rotate(q, np.array([1.0, 0, 0]))
    return math.atan2(x[1], x[0]) if math.hypot(x[0], x[1]) > 0.05 else None


def _steps(seconds: float, g0, g1, o: Fusion) -> int:
    speed = max(math.sqrt(g0 @ g0), math.sqrt(g1 @ g1))
    return max(1, math.ceil(max(seconds / o.step_seconds, seconds * (speed + o.gain + o.still_speed) / o.step_angle)))


def start_pose(t, acc, gyro, o: Fusion):
    """(pose, start, end) from the longest coherent stretch of gravity in the first window; None without one.

    Each reading is carried back into the first body frame, so turning is no error;
    a reading that is not gravity ends a stretch.
    """
    back, best, now = np.array([1.0, 0, 0, 0]), None, None

    def ended(w):
        nonlocal best
        if w and w[2] - w[1] >= o.least_window and (best is None or w[2] - w[1] > best[2] - best[1]):
            best = w

    for i in range(len(t)):
        if t[i] - t[0] > o.window:
            break
        if i:
            n, seconds = _steps(t[i] - t[i - 1], gyro[i - 1], gyro[i], o), t[i] - t[i - 1]
            for k in range(n):
                back = _mul(back, _turn(gyro[i - 1] + (gyro[i] - gyro[i - 1]) * ((k + 0.5) / n), seconds / n))
        unit = _unit(acc[i], o)
        if unit is None:
            ended(now)
            now = None
            continue
        unit = _rotate(back, unit)
        if now is not None and now[0] @ unit >= math.cos(o.coherent):
            now = (now[0], now[1], t[i], now[3] + unit)
        else:
            ended(now)
            now = (unit, t[i], t[i], unit)
    ended(now)
    if best is None:
        return None
    down = best[3] / math.sqrt(best[3] @ best[3])
    tilt = np.array([0.0, 1, 0, 0]) if down[2] < -1 + 1e-12 else np.concatenate([[1 + down[2]], np.cross(down, UP)])
    tilt = tilt / math.sqrt(tilt @ tilt)
    heading = _azimuth(tilt)
    if heading is None:
        right = _rotate(tilt, np.array([0.0, 1, 0]))
        heading = math.atan2(right[1], right[0]) - math.pi / 2
    return _mul(_turn(-heading * UP, 1.0), tilt), best[1], best[2]


def fuse(t, acc, gyro, o: Fusion, pose=None, heading: float = 0.0):
    """Rows (seconds, pose, heading) after each step, and a status; a given pose and heading are gone on from."""
    gaps = np.diff(t)
    if (gaps <= 0).any():
        return [], "not_monotonic"
    if (gaps > o.gap).any() or (np.sqrt((gyro**2).sum(1)) >= o.max_speed).any():
        return [], "gap_or_saturation"
    start = t[0]
    if pose is None:
        found = start_pose(t, acc, gyro, o)
        if found is None:
            return [], "no_gravity"
        pose, start, _ = found
    out = [(t[0], pose, heading)]
    for i in range(len(t) - 1):
        whole, n = t[i + 1] - t[i], _steps(t[i + 1] - t[i], gyro[i], gyro[i + 1], o)
        for k in range(n):
            seconds, at = whole / n, (k + 0.5) / n
            omega = gyro[i] + (gyro[i + 1] - gyro[i]) * at
            middle = _mul(pose, _turn(omega, seconds / 2))
            rate = omega
            unit = _unit(acc[i] + (acc[i + 1] - acc[i]) * at, o) if t[i] + whole * k / n >= start else None
            if unit is not None:
                up = _rotate(middle * np.array([1, -1, -1, -1]), UP)
                if unit @ up >= math.cos(o.innovation):
                    rate = omega + o.gain * np.cross(unit, up)
            pose = _mul(pose, _turn(rate, seconds))
            guess = heading + _rotate(middle, omega)[2] * seconds
            seen = _azimuth(pose)
            heading = guess if seen is None else seen + round((guess - seen) / math.tau) * math.tau
            out.append((t[i] + whole * (k + 1) / n, pose, heading))
    return out, "ok"


def gravity_fusion(df: DataFrame, by: list[str], clock: str, acc: str, gyro: str, options: Fusion | None = None, per_second: int = 1_000_000) -> DataFrame:
    """(by, seconds, q array<double>, heading, status): poses held upright by measured gravity.

    Each correction depends on the pose before it, so one recording is one ordered
    fold; give chapters as keys and chain them with `fuse` to bound it. A
    recording that breaks a rule is one row with a status.
    """
    o = options or Fusion()
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(clock)
        stack = lambda c: np.array([np.asarray(x, float) for x in part[c]])
        rows, status = fuse(part[clock].to_numpy(float) / per_second, stack(acc), stack(gyro), o)
        rows = rows or [(None, None, None)]
        made = pd.DataFrame({"seconds": [r[0] for r in rows], "q": [None if r[1] is None else r[1].tolist() for r in rows], "heading": [r[2] for r in rows], "status": status})
        for c in reversed(by):
            made.insert(0, c, part[c].iloc[0])
        return made

    fine = df.where(F.col(clock).isNotNull() & (F.size(acc) == 3) & (F.size(gyro) == 3)).select(*by, clock, acc, gyro)
    return fine.groupBy(*by).applyInPandas(run, f"{keys}, seconds double, q array<double>, heading double, status string")
