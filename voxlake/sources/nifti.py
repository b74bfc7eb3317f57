"""NIfTI-1 files: a decoder and encoder of bytes, a header-only scan, and a data source for Spark.

``read_images`` scans files with Spark's own ``binaryFile`` source, so any file system that Spark reads will do. A header-only scan
decodes 352 bytes a file and never inflates the rest.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# NIfTI-1 data type codes.
CODES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER = "c int, si int, sj int, sk int, dtype string, affine array<double>"
IMAGE = f"struct<{HEADER.replace(' ', ':').replace(',:', ',')}>"


def _inflate(data: bytes, n: int | None = None) -> bytes:
    if data[:2] != b"\x1f\x8b":
        return data
    return gzip.decompress(data) if n is None else zlib.decompressobj(31).decompress(data, n)


def quaternion_affine(b: float, c: float, d: float, shift, pixdim, qfac: float) -> np.ndarray:
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
    out = np.eye(4)
    out[:3, :3] = r * (pixdim[0], pixdim[1], pixdim[2] * qfac)
    out[:3, 3] = shift
    return out


def header(data: bytes) -> dict:
    """Shape (c, si, sj, sk), dtype, affine, scaling and data offset of a file's bytes."""
    h = _inflate(data, 352)
    order = "<" if struct.unpack("<i", h[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", h[:4])[0] != 348 or h[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", h[40:56])
    code = struct.unpack(order + "h", h[70:72])[0]
    if code not in CODES:
        raise ValueError(f"unknown NIfTI data type {code}")
    pix = struct.unpack(order + "8f", h[76:108])
    offset, slope, inter = struct.unpack(order + "3f", h[108:120])
    q, s = struct.unpack(order + "2h", h[252:256])
    if s > 0:
        affine = np.vstack([np.array(struct.unpack(order + "12f", h[280:328])).reshape(3, 4), [0, 0, 0, 1]])
    elif q > 0:
        v = struct.unpack(order + "6f", h[256:280])
        affine = quaternion_affine(*v[:3], v[3:], pix[1:4], -1.0 if pix[0] < 0 else 1.0)
    else:
        affine = np.diag([*pix[1:4], 1.0])
    shape = [max(n, 1) for n in dim[1 : dim[0] + 1]] + [1] * (7 - dim[0])
    c = shape[4] if dim[0] == 5 else shape[3]
    if dim[0] == 5 and shape[3] != 1:
        raise ValueError("a five-dimensional file must have one time point")
    return {"shape": (c, *shape[:3]), "dtype": np.dtype(order + CODES[code]), "affine": affine, "offset": int(offset), "slope": slope, "inter": inter}


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, str]:
    """Volume (C, I, J, K), affine and dtype name."""
    h = header(data)
    raw = _inflate(data)
    n = int(np.prod(h["shape"]))
    flat = np.frombuffer(raw, h["dtype"], n, h["offset"])
    volume = flat.reshape(h["shape"][::-1] if h["shape"][0] == 1 else (h["shape"][0], *h["shape"][:0:-1]))
    volume = np.moveaxis(volume.reshape((h["shape"][0], *h["shape"][:0:-1])), (1, 2, 3), (3, 2, 1))
    if h["slope"] not in (0.0, 1.0) or h["inter"] != 0:
        volume = volume * (h["slope"] or 1.0) + h["inter"]
    return volume, h["affine"], h["dtype"].newbyteorder("=").name


def encode(volume: np.ndarray, affine, *, compress: bool = False) -> bytes:
    """A single-file NIfTI-1; several channels are stored as the fifth dimension."""
    kind = next(k for k, v in CODES.items() if v == np.dtype(volume.dtype).newbyteorder("=").str[1:])
    c, si, sj, sk = volume.shape
    a = np.asarray(affine, float).reshape(4, 4)
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    dims = (3, si, sj, sk, 1, 1, 1, 1) if c == 1 else (5, si, sj, sk, 1, c, 1, 1)
    struct.pack_into("<8h", h, 40, *dims)
    struct.pack_into("<2h", h, 70, kind, volume.dtype.itemsize * 8)
    struct.pack_into("<8f", h, 76, 1.0, *np.sqrt((a[:3, :3] ** 2).sum(axis=0)), 1, 1, 1, 1)
    struct.pack_into("<3f", h, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", h, 252, 0, 2)
    struct.pack_into("<12f", h, 280, *a[:3].ravel())
    h[344:348] = b"n+1\x00"
    body = bytes(h) + np.ascontiguousarray(np.moveaxis(volume, (1, 2, 3), (3, 2, 1))).tobytes()
    return gzip.compress(body, mtime=0) if compress else body


def read_headers(spark: SparkSession, path: str, glob: str = "*.nii*") -> DataFrame:
    """path and header columns of all files."""

    @F.pandas_udf(HEADER)
    def parse(content: pd.Series) -> pd.DataFrame:
        rows = [header(bytes(b)) for b in content]
        return pd.DataFrame([[*h["shape"], h["dtype"].newbyteorder("=").name, h["affine"].ravel()] for h in rows], columns=["c", "si", "sj", "sk", "dtype", "affine"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    # only the first bytes go to Python; ``backends.scan`` with header reads no more than these at all
    return files.select("path", parse(F.expr("substring(content, 1, 4096)")).alias("h")).select("path", "h.*")


def read_images(spark: SparkSession, path: str, glob: str = "*.nii*") -> DataFrame:
    """path and an image struct of every file."""

    @F.pandas_udf("c int, si int, sj int, sk int, affine array<double>, data array<double>")
    def parse(content: pd.Series) -> pd.DataFrame:
        rows = []
        for b in content:
            v, a, _ = decode(bytes(b))
            rows.append([*v.shape, a.ravel(), v.astype(float).ravel()])
        return pd.DataFrame(rows, columns=["c", "si", "sj", "sk", "affine", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", parse("content").alias("image"))


def write_images(df: DataFrame, name: str, key: str, path: str, *, compress: bool = False) -> None:
    """One row a file as (key, content) in a Parquet data set; the committer makes retries harmless. ``content`` is a whole NIfTI file."""

    @F.pandas_udf("binary")
    def pack(img: pd.DataFrame) -> pd.Series:
        return pd.Series([encode(np.asarray(r.data, dtype=np.float32).reshape(r.c, r.si, r.sj, r.sk), r.affine, compress=compress) for r in img.itertuples()])

    df.select(F.col(key).alias("key"), pack(name).alias("content")).write.mode("overwrite").parquet(path)
