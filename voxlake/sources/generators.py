"""Synthetic volumes and transform-matrix files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def zone_plate(spark: SparkSession, size: int) -> DataFrame:
    """(i, j, k, v): a zone plate of size**3 voxels about the world's origin; voxel 0 lies at zone_plate_start(size) on every axis.

    Rings sin(0.8 pi r**2 / 2R) times a factor that begins to fall where r comes near R. R is the first coordinate, so it is negative.
    """
    start = zone_plate_start(size)
    p, big = F.col("id"), float(start)
    rows = spark.range(size**3).select(F.floor(p / (size * size)).alias("i"), (F.floor(p / size) % size).alias("j"), (p % size).alias("k"))
    r2 = sum(((F.col(a) + start) * (F.col(a) + start) for a in "jk"), (F.col("i") + start) * (F.col("i") + start))
    v = F.sin(F.lit(0.8 * np.pi) * r2 / (2 * big)) * (F.lit(0.5) * F.tanh((big - F.sqrt(r2)) / (big / 10)) + 0.5)
    return rows.select("i", "j", "k", v.alias("v"))


def zone_plate_start(size: int) -> int:
    if size < 3:
        raise ValueError("a zone plate has at least 3 voxels an axis")
    return -((size - 1) // 2)


def read_matrix(text: str) -> np.ndarray:
    """World matrix (RAS) of an ITK transform text (LPS parameters about a centre) or a plain 4 x 4 table (of the inverse)."""
    if "Parameters:" not in text:
        return np.linalg.inv(np.array([[float(x) for x in line.split()] for line in text.strip().splitlines()]))
    lines = dict(line.split(":", 1) for line in text.splitlines() if ":" in line and not line.startswith("#"))
    p = np.array([float(x) for x in lines["Parameters"].split()])
    c = np.array([float(x) for x in lines.get("FixedParameters", "0 0 0").split()])
    m = np.eye(4)
    m[:3, :3] = p[:9].reshape(3, 3)
    m[:3, 3] = p[9:] + c - m[:3, :3] @ c
    f = np.diag([-1.0, -1, 1, 1])
    return np.linalg.inv(f @ m @ f)


def write_matrix(m: np.ndarray, kind: str = "itk") -> str:
    """The text that read_matrix reads."""
    inv = np.linalg.inv(np.asarray(m, float))
    if kind == "table":
        return "\n".join(" ".join(f"{x:.8f}" for x in row) for row in inv) + "\n"
    f = np.diag([-1.0, -1, 1, 1])
    t = f @ inv @ f
    numbers = " ".join(repr(float(x)) for x in (*t[:3, :3].ravel(), *t[:3, 3]))
    return f"#Insight Transform File V1.0\n#Transform 0\nTransform: AffineTransform_double_3_3\nParameters: {numbers}\nFixedParameters: 0 0 0\n"
