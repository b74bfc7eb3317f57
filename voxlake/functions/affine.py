"""Affine matrices (16 doubles, row by row) as column expressions, and orientation codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def at(a: Column, r: int, c: int) -> Column:
    return F.get(a, F.lit(4 * r + c))


def from_spacing(spacing: list, origin: list) -> Column:
    z = F.lit(0.0)
    v = [x if isinstance(x, Column) else F.lit(float(x)) for x in (*spacing, *origin)]
    v = [x.cast("double") for x in v]
    return F.array(v[0], z, z, v[3], z, v[1], z, v[4], z, z, v[2], v[5], z, z, z, F.lit(1.0))


def spacing(a: Column) -> list[Column]:
    return [F.sqrt(at(a, 0, c) * at(a, 0, c) + at(a, 1, c) * at(a, 1, c) + at(a, 2, c) * at(a, 2, c)) for c in range(3)]


def origin(a: Column) -> list[Column]:
    return [at(a, r, 3) for r in range(3)]


def apply(a: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [at(a, r, 0) * x + at(a, r, 1) * y + at(a, r, 2) * z + at(a, r, 3) for r in range(3)]


def determinant(a: Column) -> Column:
    m = lambda r, c: at(a, r, c)
    return m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))


def inverse(a: Column) -> Column:
    """By cofactors; null for a singular matrix."""
    m = lambda r, c: at(a, r, c)
    det = F.nullif(determinant(a), F.lit(0.0))
    inv = [[None] * 3 for _ in range(3)]
    for r in range(3):
        for c in range(3):
            p, q = [k for k in range(3) if k != c], [k for k in range(3) if k != r]
            inv[r][c] = (m(p[0], q[0]) * m(p[1], q[1]) - m(p[0], q[1]) * m(p[1], q[0])) * (1 if (r + c) % 2 == 0 else -1) / det
    shift = [-(inv[r][0] * m(0, 3) + inv[r][1] * m(1, 3) + inv[r][2] * m(2, 3)) for r in range(3)]
    return F.array(*(v for r in range(3) for v in (*inv[r], shift[r])), *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def compose(a: Column, b: Column) -> Column:
    return F.array(*(sum((at(a, r, k) * at(b, k, c) for k in range(1, 4)), at(a, r, 0) * at(b, 0, c)) for r in range(4) for c in range(4)))


def euler(a: Column) -> list[Column]:
    """XYZ angles in degrees of the direction cosines."""
    s = spacing(a)
    m = lambda r, c: at(a, r, c) / s[c]
    sy = F.sqrt(m(0, 0) * m(0, 0) + m(1, 0) * m(1, 0))
    regular = sy >= 1e-6
    return [
        F.degrees(F.when(regular, F.atan2(m(2, 1), m(2, 2))).otherwise(F.atan2(-m(1, 2), m(1, 1)))),
        F.degrees(F.atan2(-m(2, 0), sy)),
        F.degrees(F.when(regular, F.atan2(m(1, 0), m(0, 0))).otherwise(F.lit(0.0))),
    ]


def shifted(a: Column, i: Column, j: Column, k: Column) -> Column:
    """The affine whose origin lies at the voxel (i, j, k)."""
    moved = apply(a, i, j, k)
    return F.array(*(moved[r] if c == 3 and r < 3 else at(a, r, c) for r in range(4) for c in range(4)))


def orientation(a: Column) -> Column:
    """Axis codes such as RAS, for matrices whose largest entries by column lie in different rows."""
    codes = []
    for c in range(3):
        m = [at(a, r, c) for r in range(3)]
        top = F.greatest(*(F.abs(x) for x in m))
        code = F.lit("?")
        for r in (2, 1, 0):
            code = F.when(F.abs(m[r]) == top, F.when(m[r] >= 0, "RAS"[r]).otherwise("LPI"[r])).otherwise(code)
        codes.append(code)
    return F.concat(*codes)


#: The world axis of each anatomical letter.
LETTERS = {"R": 0, "L": 0, "A": 1, "P": 1, "S": 2, "I": 2}


def axis_mapping(source: str, target: str) -> tuple[list[int], list[int]]:
    """For each target axis: the source axis and whether it keeps (1) or flips (-1) its sense."""
    pairs = LETTERS
    for axes in (source, target):
        anatomical = set(axes) <= set(pairs) and sorted(pairs[x] for x in axes) == [0, 1, 2]
        if len(axes) != 3 or not (sorted(axes) == ["I", "J", "K"] or anatomical):
            raise ValueError(f"invalid axes {axes!r}")
    if (sorted(source) == ["I", "J", "K"]) != (sorted(target) == ["I", "J", "K"]):
        raise ValueError("voxel and anatomical axes need an affine to be mapped")
    if sorted(source) == ["I", "J", "K"]:
        return [source.index(x) for x in target], [1, 1, 1]
    order = [next(k for k, s in enumerate(source) if pairs[s] == pairs[t]) for t in target]
    return order, [1 if source[k] == t else -1 for k, t in zip(order, target, strict=True)]


def euler_matrix(degrees) -> np.ndarray:
    x, y, z = np.radians(degrees)
    rx = np.array([[1, 0, 0], [0, np.cos(x), -np.sin(x)], [0, np.sin(x), np.cos(x)]])
    ry = np.array([[np.cos(y), 0, np.sin(y)], [0, 1, 0], [-np.sin(y), 0, np.cos(y)]])
    rz = np.array([[np.cos(z), -np.sin(z), 0], [np.sin(z), np.cos(z), 0], [0, 0, 1]])
    return rz @ ry @ rx
