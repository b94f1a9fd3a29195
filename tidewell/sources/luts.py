"""Colour cubes in text files: a header and size^3 rows of three numbers, red fastest."""

from __future__ import annotations

from dataclasses import dataclass

#: Limits of a cube.
LEAST, MOST = 2, 129


@dataclass(frozen=True)
class Cube:
    size: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    values: tuple[tuple[float, float, float], ...]

    def channel(self, c: int) -> list[float]:
        """One channel's entries, as `colour.grid` takes them."""
        return [v[c] for v in self.values]


def _three(fields: list[str]) -> tuple[float, float, float]:
    import math

    found = tuple(float(f) for f in fields)
    if len(found) != 3 or not all(map(math.isfinite, found)):
        raise ValueError("three finite numbers are due")
    return found


def parse_cube(text: str) -> Cube:
    """The cube of a text; ValueError names the first line that breaks a rule. Headers come once and before the numbers."""
    head: dict[str, object] = {}
    values: list[tuple[float, float, float]] = []
    for number, raw in enumerate(text.removeprefix("﻿").splitlines(), 1):
        line = raw.strip()
        if not line.startswith("TITLE"):
            line = line.split("#")[0].strip()
        if not line or line.startswith("#"):
            continue
        name, *rest = line.split()
        try:
            if not name[0].isalpha() or name.lower() in ("nan", "inf", "infinity"):
                if "LUT_3D_SIZE" not in head or len(values) == head["LUT_3D_SIZE"] ** 3:
                    raise ValueError("numbers without or beyond a size")
                values.append(_three([name, *rest]))
                continue
            if values or name in head:
                raise ValueError("header repeated or after numbers")
            if name == "TITLE":
                if line.count('"') != 2:
                    raise ValueError("title without quotes")
                head[name] = line
            elif name == "LUT_3D_SIZE" and len(rest) == 1 and LEAST <= int(rest[0]) <= MOST:
                head[name] = int(rest[0])
            elif name in ("DOMAIN_MIN", "DOMAIN_MAX") and "LUT_3D_INPUT_RANGE" not in head:
                head[name] = _three(rest)
            elif name == "LUT_3D_INPUT_RANGE" and len(rest) == 2 and not head.keys() & {"DOMAIN_MIN", "DOMAIN_MAX"}:
                head[name] = tuple(map(float, rest))
            else:
                raise ValueError("header")
        except ValueError as e:
            raise ValueError(f"line {number}: {e}") from None
    size = head.get("LUT_3D_SIZE")
    if size is None or len(values) != size**3:
        raise ValueError("number of rows")
    both = head.get("LUT_3D_INPUT_RANGE", (0.0, 1.0))
    low, high = (head.get(n, (both[i],) * 3) for i, n in enumerate(("DOMAIN_MIN", "DOMAIN_MAX")))
    if any(a >= b for a, b in zip(low, high, strict=True)):
        raise ValueError("domain")
    return Cube(size, low, high, tuple(values))
