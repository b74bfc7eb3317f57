"""Points and bounding boxes as columns: axes, world coordinates, representations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions import affine as A
from .volume import orientation


def _voxel(axes: str) -> bool:
    return sorted(axes) == ["I", "J", "K"]


def parts(values: Column, n: int) -> list[Column]:
    return [F.get(values, F.lit(d)) for d in range(n)]


def _across(source: str, target: str):
    """A function of points and affines, in Arrow batches, between voxel and anatomical axes."""

    def moved(p: np.ndarray, m: np.ndarray) -> np.ndarray:
        codes = orientation(m)
        if _voxel(source):
            world = m[:3, :3] @ p[[source.index(x) for x in "IJK"]] + m[:3, 3]
            order, signs = A.axis_mapping(codes, target)
            return world[order] * signs
        order, signs = A.axis_mapping(source, codes)
        ijk = np.linalg.solve(m[:3, :3], p[order] * signs - m[:3, 3])
        return ijk[["IJK".index(x) for x in target]]

    def run(points: pd.Series, affines: pd.Series) -> pd.Series:
        return pd.Series([moved(np.asarray(p, float), np.asarray(a, float).reshape(4, 4)).tolist() for p, a in zip(points, affines, strict=True)])

    return F.pandas_udf(run, "array<double>")


def to_axes(point: list[Column], source: str, target: str, shape: list[Column] | None = None, affine: Column | None = None) -> list[Column]:
    """Coordinates for other axes: permuted, and with the opposite sign where the sense changes (or counted from the other end, given a shape).

    Between voxel and anatomical axes the affine maps; the world's axes are taken to be the affine's own orientation.
    """
    if _voxel(source) != _voxel(target) and affine is not None:
        return parts(_across(source, target)(F.array(*point), affine), 3)
    order, signs = A.axis_mapping(source, target)
    flipped = lambda d: -point[d] if shape is None else shape[d] - 1 - point[d]
    return [point[d] if s > 0 else flipped(d) for d, s in zip(order, signs, strict=True)]


def to_world(point: list[Column], affine: Column) -> list[Column]:
    return A.apply(affine, *point)


def to_voxel(point: list[Column], affine: Column) -> list[Column]:
    return A.apply(A.inverse(affine), *point)


def corners_to_center(box: list[Column]) -> list[Column]:
    lo, hi = box[:3], box[3:]
    return [*((a + b) / 2 for a, b in zip(lo, hi, strict=True)), *(b - a for a, b in zip(lo, hi, strict=True))]


def center_to_corners(box: list[Column]) -> list[Column]:
    mid, size = box[:3], box[3:]
    return [*(m - s / 2 for m, s in zip(mid, size, strict=True)), *(m + s / 2 for m, s in zip(mid, size, strict=True))]


def _ordered(a: list[Column], b: list[Column]) -> list[Column]:
    return [*(F.least(x, y) for x, y in zip(a, b, strict=True)), *(F.greatest(x, y) for x, y in zip(a, b, strict=True))]


def corners_to_axes(box: list[Column], source: str, target: str, affine: Column | None = None) -> list[Column]:
    return _ordered(to_axes(box[:3], source, target, affine=affine), to_axes(box[3:], source, target, affine=affine))


def corners_to_world(box: list[Column], affine: Column) -> list[Column]:
    """Both corners mapped and put in order again (not the tight box under a rotation)."""
    return _ordered(to_world(box[:3], affine), to_world(box[3:], affine))


def corners_to_voxel(box: list[Column], affine: Column) -> list[Column]:
    return _ordered(to_voxel(box[:3], affine), to_voxel(box[3:], affine))


FORMS = ("corners", "center_size")


def to_format(box: list[Column], source: tuple[str, str], target: tuple[str, str], affine: Column | None = None) -> list[Column]:
    """Boxes from one (axes, form) to another; a form is corners or center_size."""
    for _, form in (source, target):
        if form not in FORMS:
            raise ValueError(f"unknown form {form!r}")

    corners = center_to_corners(box) if source[1] == "center_size" else box
    there = corners if source[0] == target[0] else corners_to_axes(corners, source[0], target[0], affine)
    return corners_to_center(there) if target[1] == "center_size" else there
