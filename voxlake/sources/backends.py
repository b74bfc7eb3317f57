"""Volumes in files: formats by suffix, a Spark data source with header-only and region reads, and bricks for large volumes.

``spark.read.format("voxlake")`` lists files with pyarrow's file systems and opens them on the executors. With ``header`` only the header is
read; with ``region`` (an index such as ``:, 10:20, 0:64, 5``) an uncompressed NIfTI file is read only where the region lies, row by row of
its fastest axis. File systems that only Spark reads go through ``nifti.read_images``, which uses Spark's own ``binaryFile``.
"""

from __future__ import annotations

import fnmatch
import gzip
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.image import AXES
from ..functions.slicing import index_affine, normalize_index, parse_index
from . import nifti

HEADER = "path string, c int, si int, sj int, sk int, dtype string, affine array<double>"
IMAGE = "path string, image struct<c:int,si:int,sj:int,sk:int,affine:array<double>,data:array<double>>"


@dataclass(frozen=True)
class Backend:
    """head(file) -> dict with shape, dtype and affine; load(file, index) -> (volume, affine). file is open for reading and seeking."""

    head: Callable
    load: Callable


# --- NIfTI ---
def _nifti_head(f) -> dict:
    start = f.read(2)
    f.seek(0)
    h = nifti.header(gzip.GzipFile(fileobj=f).read(352) if start == b"\x1f\x8b" else f.read(352))
    return {**h, "packed": start == b"\x1f\x8b"}


def _nifti_load(f, index: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    h = _nifti_head(f)
    f.seek(0)
    if index is None or h["packed"]:
        volume, affine, _ = nifti.decode(f.read())
        return (volume, affine) if index is None else (volume[index], index_affine(affine, index[1:], h["shape"][1:]))
    places = [range(n)[s] for s, n in zip(index, h["shape"], strict=True)]
    c, si, sj, sk = h["shape"]
    size = h["dtype"].itemsize
    out = np.empty([len(p) for p in places], h["dtype"])
    if out.size:
        lo, hi = min(places[1]), max(places[1]) + 1
        picks = np.array(places[1]) - lo
        for a, n in enumerate(places[0]):
            for b, k in enumerate(places[3]):
                for d, j in enumerate(places[2]):
                    f.seek(h["offset"] + ((((n * sk + k) * sj) + j) * si + lo) * size)
                    out[a, :, d, b] = np.frombuffer(f.read((hi - lo) * size), h["dtype"])[picks]
    scaled = out if h["slope"] in (0.0, 1.0) and h["inter"] == 0 else out * (h["slope"] or 1.0) + h["inter"]
    return scaled, index_affine(h["affine"], index[1:], h["shape"][1:])


# --- NRRD: attached headers, raw or gzip, space directions as LPS or RAS ---
# NRRD type names.
_NRRD = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "signed char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "longlong": "i8", "int64": "i8", "float": "f4", "double": "f8"}


def _nrrd_head(f) -> dict:
    data = b""
    while b"\n\n" not in data.replace(b"\r", b""):
        more = f.read(4096)
        if not more:
            raise ValueError("not an attached NRRD file")
        data += more
    text = data.replace(b"\r", b"")
    text = text[: text.index(b"\n\n")].decode("latin-1")
    if not text.startswith("NRRD"):
        raise ValueError("not a NRRD file")
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in text.splitlines()[1:] if ":" in line and not line.startswith("#"))}
    sizes = [int(x) for x in fields["sizes"].split()]
    order = ">" if fields.get("endian") == "big" else "<"
    affine = np.eye(4)
    vectors = [v for v in fields.get("space directions", "").replace("none", "").split() if v]
    for d, v in enumerate(vectors[-3:]):
        affine[:3, d] = [float(x) for x in v.strip("()").split(",")]
    if "space origin" in fields:
        affine[:3, 3] = [float(x) for x in fields["space origin"].strip("()").split(",")]
    if fields.get("space", "left-posterior-superior").lower() in ("left-posterior-superior", "lps"):
        affine = np.diag([-1.0, -1, 1, 1]) @ affine if vectors else affine
    shape = (sizes[0], *sizes[1:]) if len(sizes) == 4 else (1, *sizes, *[1] * (3 - len(sizes)))
    start = data.index(b"\n\n") + 2 if b"\n\n" in data else data.index(b"\r\n\r\n") + 4
    return {"shape": shape, "dtype": np.dtype(order + _NRRD[fields["type"]]), "affine": affine, "offset": start, "packed": fields.get("encoding", "raw") in ("gzip", "gz")}


def _nrrd_load(f, index: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    h = _nrrd_head(f)
    f.seek(h["offset"])
    raw = gzip.decompress(f.read()) if h["packed"] else f.read()
    volume = np.frombuffer(raw, h["dtype"], int(np.prod(h["shape"]))).reshape(h["shape"], order="F")  # the channel runs fastest
    return (volume, h["affine"]) if index is None else (volume[index], index_affine(h["affine"], index[1:], h["shape"][1:]))


def write_nrrd(volume: np.ndarray, affine, *, compress: bool = False) -> bytes:
    """An attached NRRD file in LPS."""
    a = np.diag([-1.0, -1, 1, 1]) @ np.asarray(affine, float).reshape(4, 4)
    kind = next(k for k, v in _NRRD.items() if v == np.dtype(volume.dtype).newbyteorder("=").str[1:])
    vector = lambda v: "(" + ",".join(repr(float(x)) for x in v) + ")"
    multi = volume.shape[0] > 1
    sizes = volume.shape if multi else volume.shape[1:]
    lines = ["NRRD0004", f"type: {kind}", f"dimension: {len(sizes)}", "space: left-posterior-superior", f"sizes: {' '.join(map(str, sizes))}", "space directions: " + ("none " if multi else "") + " ".join(vector(a[:3, d]) for d in range(3)), f"space origin: {vector(a[:3, 3])}", "endian: little", f"encoding: {'gzip' if compress else 'raw'}"]
    body = volume.astype(volume.dtype.newbyteorder("<")).tobytes(order="F")
    return ("\n".join(lines) + "\n\n").encode() + (gzip.compress(body, mtime=0) if compress else body)


# --- NumPy arrays, affine unknown ---
def _npy_head(f) -> dict:
    version = np.lib.format.read_magic(f)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    return {"shape": shape if len(shape) == 4 else (1, *shape), "dtype": kind, "affine": np.eye(4)}


def _npy_load(f, index: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    volume = np.load(f)
    volume = volume if volume.ndim == 4 else volume[None]
    return (volume, np.eye(4)) if index is None else (volume[index], index_affine(np.eye(4), index[1:], volume.shape[1:]))


BACKENDS: dict[str, Backend] = {".nii": Backend(_nifti_head, _nifti_load), ".nii.gz": Backend(_nifti_head, _nifti_load), ".nrrd": Backend(_nrrd_head, _nrrd_load), ".npy": Backend(_npy_head, _npy_load)}


def register_backend(suffix: str, backend: Backend) -> None:
    """Adds or replaces the format of a suffix; its functions go to the executors with each read."""
    BACKENDS[suffix] = backend


def backend_of(path: str, known: dict[str, Backend] | None = None) -> Backend:
    """By the longest suffix that fits; none raises."""
    known = known or BACKENDS
    name = posixpath.basename(path).lower()
    for suffix in sorted(known, key=len, reverse=True):
        if name.endswith(suffix):
            return known[suffix]
    raise ValueError(f"no format for {path!r}; known are {sorted(known)}")


# --- the data source ---
@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, known: dict[str, Backend]):
        self.options, self.known = options, known
        self.header = str(options.get("header", "false")).lower() == "true"
        self.index = normalize_index(parse_index(options["region"])) if options.get("region") else None

    def partitions(self) -> list[_Files]:
        system, top = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])
        info = system.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True))
        pattern = self.options.get("glob", "*")
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(f.path), pattern) and any(f.path.lower().endswith(s) for s in self.known))
        if not files and info.type == fs.FileType.File:
            raise ValueError(f"no format for {top!r}; known are {sorted(self.known)}")
        out, held, size = [], [], 0
        for path, n in files:
            held.append(path)
            size += 4096 if self.header else n
            if size >= 64 << 20 or len(held) >= 4096:
                out.append(_Files(held))
                held, size = [], 0
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:
        where = self.options["path"]
        system = fs.FileSystem.from_uri(where)[0] if "://" in where else fs.LocalFileSystem()
        for path in partition.paths:
            backend = backend_of(path, self.known)
            with system.open_input_file(path) as f:
                if self.header:
                    h = backend.head(f)
                    yield (path, *map(int, h["shape"]), np.dtype(h["dtype"]).newbyteorder("=").name, np.asarray(h["affine"], float).ravel().tolist())
                else:
                    x, a = backend.load(f, self.index)
                    yield (path, (*map(int, x.shape), np.asarray(a, float).ravel().tolist(), np.asarray(x, float).ravel().tolist()))


def source(known: dict[str, Backend] | None = None) -> type[DataSource]:
    """The data source class with the formats known now."""
    formats = dict(known or BACKENDS)

    class VolumeSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "voxlake"

        def schema(self) -> str:
            return HEADER if str(self.options.get("header", "false")).lower() == "true" else IMAGE

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), formats)

    return VolumeSource


def scan(spark: SparkSession, path: str, *, header: bool = False, region: str | None = None, glob: str = "*", reader: Callable | None = None) -> DataFrame:
    """path and an image struct (or the header's columns) of every file below path.

    reader(file) -> (volume, affine) reads files of any suffix instead of the registered formats.
    """
    known = BACKENDS
    if reader is not None:
        load = lambda f, index: _indexed(*reader(f), index)
        known = {"": Backend(lambda f: _head_of(*reader(f)), load)}
    spark.dataSource.register(source(known))
    frame = spark.read.format("voxlake").option("header", str(header).lower()).option("glob", glob)
    return (frame.option("region", region) if region else frame).load(path)


def _indexed(x: np.ndarray, affine: np.ndarray, index: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    x = x if x.ndim == 4 else x[None]
    return (x, affine) if index is None else (x[index], index_affine(affine, index[1:], x.shape[1:]))


def _head_of(x: np.ndarray, affine: np.ndarray) -> dict:
    x = x if x.ndim == 4 else x[None]
    return {"shape": x.shape, "dtype": x.dtype, "affine": affine}


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir), or below the warehouse of a local session."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(top or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    return path.removeprefix("file://").removeprefix("file:")


def save_files(df: DataFrame, name: str, key: str, folder: str, suffix: str = ".nii") -> DataFrame:
    """Writes every image as a file of its own below a folder that all executors share; returns key and path.

    A file appears under its name when it is whole, so a task that runs again only replaces it.
    """
    compress = suffix.endswith(".gz")
    system_of = lambda: fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)

    def write(batches):
        system, top = system_of()
        system.create_dir(top, recursive=True)
        for batch in batches:
            paths = []
            for r in batch.to_pylist():
                x = np.array(r["image"]["data"]).reshape([r["image"][a] for a in ("c", *AXES)])
                x = x.astype(np.int32 if x.dtype.kind in "iu" else np.float64)
                body = write_nrrd(x, r["image"]["affine"]) if suffix == ".nrrd" else nifti.encode(x, r["image"]["affine"], compress=compress)
                path = f"{top}/{r['key']}{suffix}"
                with system.open_output_stream(f"{path}.{id(r)}.part") as f:
                    f.write(body)
                system.move(f"{path}.{id(r)}.part", path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["key", "path"])

    rows = df.select(F.col(key).alias("key"), F.col(name).alias("image"))
    return rows.mapInArrow(write, f"key {dict(rows.dtypes)['key']}, path string")


# --- bricks: volumes beyond a row ---
def bricks(df: DataFrame, name: str, key: str, brick: tuple[int, int, int]) -> DataFrame:
    """(key, bi, bj, bk, shape, affine, image): an image cut into bricks of at most a size; each is an image with an affine of its own."""
    x = F.col(name)
    per = [F.sequence(F.lit(0), F.floor((x[a] - 1) / b).cast("int")) for a, b in zip(AXES, brick, strict=True)]
    places = F.flatten(F.flatten(F.transform(per[0], lambda i: F.transform(per[1], lambda j: F.transform(per[2], lambda k: F.struct(i.alias("bi"), j.alias("bj"), k.alias("bk")))))))
    rows = df.select(F.col(key).alias("key"), x.alias("x"), F.explode(places).alias("at")).select("key", "x", "at.*")
    kind = df.schema[name].dataType

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                v = r["x"]
                data, a = np.array(v["data"]).reshape([v[n] for n in ("c", *AXES)]), np.array(v["affine"]).reshape(4, 4)
                index = (slice(None), *(slice(r[n] * b, min((r[n] + 1) * b, s)) for n, b, s in zip(("bi", "bj", "bk"), brick, data.shape[1:], strict=True)))
                part = data[index]
                out.append({**{n: r[n] for n in ("key", "bi", "bj", "bk")}, "shape": list(data.shape), "affine": v["affine"], "image": {"c": part.shape[0], **dict(zip(AXES, part.shape[1:], strict=True)), "affine": index_affine(a, index[1:], data.shape[1:]).ravel().tolist(), "data": part.ravel().tolist()}})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    schema = f"key {dict(rows.dtypes)['key']}, bi int, bj int, bk int, shape array<int>, affine array<double>, image {kind.simpleString()}"
    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(run, schema)


def read_region(cut: DataFrame, brick: tuple[int, int, int], region: str) -> DataFrame:
    """(key, image): a region of every bricked volume. Only bricks that meet it are read: their numbers are columns that Parquet filters by."""
    box = normalize_index(parse_index(region), 3)
    if any(s.step not in (None, 1) or (s.start or 0) < 0 or (s.stop is not None and s.stop < 0) for s in box):
        raise ValueError("a region of bricks has steps of 1 and counts from the start")
    keep = F.lit(True)
    for n, b, s in zip(("bi", "bj", "bk"), brick, box, strict=True):
        keep = keep & (F.col(n) >= (s.start or 0) // b)
        if s.stop is not None:
            keep = keep & (F.col(n) <= (s.stop - 1) // b)
    rows = cut.where(keep)
    kind = rows.schema["image"].dataType
    schema = f"key {dict(rows.dtypes)['key']}, image {kind.simpleString()}"

    def join(t: pa.Table) -> pa.Table:
        parts = t.to_pylist()
        c, *shape = parts[0]["shape"]
        span = [s.indices(n)[:2] for s, n in zip(box, shape, strict=True)]
        out = np.zeros((c, *(max(b - a, 0) for a, b in span)))
        for p in parts:
            v = p["image"]
            data = np.array(v["data"]).reshape([v[n] for n in ("c", *AXES)])
            start = [p[n] * b for n, b in zip(("bi", "bj", "bk"), brick, strict=True)]
            lo = [max(a, s) for (a, _), s in zip(span, start, strict=True)]
            hi = [min(b, s + n) for (_, b), s, n in zip(span, start, data.shape[1:], strict=True)]
            if all(a < b for a, b in zip(lo, hi, strict=True)):
                there = (slice(None), *(slice(a - z, b - z) for a, b, (z, _) in zip(lo, hi, span, strict=True)))
                here = (slice(None), *(slice(a - s, b - s) for a, b, s in zip(lo, hi, start, strict=True)))
                out[there] = data[here]
        affine = index_affine(np.array(parts[0]["affine"]), tuple(slice(a, b) for a, b in span), shape)
        row = {"key": parts[0]["key"], "image": {"c": c, **dict(zip(AXES, out.shape[1:], strict=True)), "affine": affine.ravel().tolist(), "data": out.ravel().tolist()}}
        return pa.Table.from_pylist([row], schema=target)

    target = to_arrow_schema(cut.sparkSession.createDataFrame([], schema).schema)
    return rows.groupBy("key").applyInArrow(join, schema)


# --- folders of several kinds of images ---
def scan_modalities(spark: SparkSession, root: str, modalities: list[str], *, glob: str = "*", subject: str = r"([^/]+)-[^/-]+$") -> DataFrame:
    """subject_id and one image column for each folder below root, of the subjects that all folders hold.

    subject: a regular expression for the name without its suffix, whose first group is the subject.
    """
    out = None
    for m in modalities:
        stem = F.regexp_replace(F.regexp_extract("path", r"[^/]+$", 0), r"\.(nii\.gz|[^.]+)$", "")
        rows = scan(spark, f"{root.rstrip('/')}/{m}", glob=glob).select(F.regexp_extract(stem, subject, 1).alias("subject_id"), F.col("image").alias(m)).where("subject_id <> ''")
        out = rows if out is None else out.join(rows, "subject_id")
    return out


def zip_strict(left: DataFrame, right: DataFrame, order_left: str, order_right: str, by: str) -> DataFrame:
    """Rows of two tables paired by position inside each group; groups of unequal size raise. A group's rows are sorted in one task."""
    number = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(o)))
    a, b = number(left, order_left), number(right, order_right).withColumnRenamed(by, "_by")
    both = a.join(b, (a[by] == b["_by"]) & (a["_n"] == b["_n"]), "full").drop("_n")
    whole = F.when(F.col(by).isNull() | F.col("_by").isNull(), F.raise_error(F.lit("the two sides have groups of unequal size"))).otherwise(F.col(by))
    return both.withColumn(by, whole).drop("_by")
