"""Patch operators: grids and random places, extraction, and reassembly by aggregation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rng
from ..functions.image import AXES, gather, position
from .batches import ranked


def starts(n: Column, patch: int, overlap: int = 0) -> Column:
    """First voxels of the patches along an axis: equal steps and a last one that ends with the image."""
    step = max(patch - overlap, 1)
    last = F.greatest(n - patch, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), F.floor(last / step).cast("int") * step, F.lit(step)), F.array(last.cast("int"))))


def grid_locations(df: DataFrame, name: str, patch: tuple, overlap: tuple = (0, 0, 0), keys: tuple = ("subject_id",)) -> DataFrame:
    """keys, patch_ord, i0, j0, k0 in the order i, j, k. Borders are padded before by the transform Pad, half an overlap on each side."""
    out = df.select(*keys, *(starts(F.col(name)[a], p, o).alias(a) for a, p, o in zip(AXES, patch, overlap, strict=True)))
    places = F.flatten(F.flatten(F.transform("si", lambda i: F.transform("sj", lambda j: F.transform("sk", lambda k: F.struct(i.alias("i0"), j.alias("j0"), k.alias("k0")))))))
    return out.select(*keys, F.posexplode(places).alias("patch_ord", "at")).select(*keys, "patch_ord", "at.*")


def extract(img: Column, at: tuple[Column, Column, Column], patch: tuple) -> Column:
    """Data of the patch at a place; a patch larger than the image raises."""
    i0, j0, k0 = at
    data = gather(img, (img["c"], *map(F.lit, patch)), lambda c, i, j, k: position(c, i + i0, j + j0, k + k0, img["si"], img["sj"], img["sk"]))
    fits = (i0 + patch[0] <= img["si"]) & (j0 + patch[1] <= img["sj"]) & (k0 + patch[2] <= img["sk"])
    return F.when(fits, data).otherwise(F.raise_error(F.lit("the patch is larger than the image")))


def grid_patches(df: DataFrame, name: str, patch: tuple, overlap: tuple = (0, 0, 0), keys: tuple = ("subject_id",)) -> DataFrame:
    """keys, patch_ord, i0, j0, k0, data: exploded beside the image, without a join."""
    per = [starts(F.col(name)[a], p, o) for a, p, o in zip(AXES, patch, overlap, strict=True)]
    places = F.flatten(F.flatten(F.transform(per[0], lambda i: F.transform(per[1], lambda j: F.transform(per[2], lambda k: F.struct(i.alias("i0"), j.alias("j0"), k.alias("k0")))))))
    rows = df.select(*keys, name, F.posexplode(places).alias("patch_ord", "at"))
    return rows.select(*keys, "patch_ord", "at.*", extract(F.col(name), (F.col("at.i0"), F.col("at.j0"), F.col("at.k0")), patch).alias("data"))


def uniform_patches(df: DataFrame, name: str, patch: tuple, count: int, *, seed: int = 0, key: str = "subject_id") -> DataFrame:
    """key, patch_ord, i0, j0, k0 of count random patches of each row."""
    rows = df.select(key, name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("patch_ord"))
    each = F.concat_ws(":", F.col(key).cast("string"), F.col("patch_ord").cast("string"))
    place = lambda a, p: F.floor(rng.uniform(seed, f"patch.{a}", each) * (F.greatest(F.col(name)[a] - p, F.lit(0)) + 1))
    return rows.select(key, "patch_ord", *(place(a, p).alias(o) for a, p, o in zip(AXES, patch, ("i0", "j0", "k0"), strict=True)))


def weighted_patches(df: DataFrame, name: str, weight_map: str, patch: tuple, count: int, *, seed: int = 0, key: str = "subject_id") -> DataFrame:
    """Centres drawn in proportion to a map whose borders of half a patch count 0; rows without weight raise.

    Running sums and searches by array operations; the draws are columns.
    """
    m = F.col(weight_map)
    each = lambda n: F.concat_ws(":", F.col(key).cast("string"), F.lit(str(n)))
    draws = F.array(*(rng.uniform(seed, "patch.w", each(n)) for n in range(count)))

    def places(data: pd.Series, shape: pd.DataFrame, u: pd.Series) -> pd.Series:
        out = []
        for d, n, x in zip(data, shape.to_numpy(), u, strict=True):
            size = n[1:]
            weight = np.asarray(d, dtype=float)[: int(np.prod(size))].reshape(size)
            inside = np.zeros(size)
            box = tuple(slice(q // 2, k - q // 2) for q, k in zip(patch, size, strict=True))
            inside[box] = weight[box]
            sums = np.cumsum(inside.ravel())
            if not sums[-1] > 0:
                raise ValueError("the map has no weight")
            at = np.searchsorted(sums, np.asarray(x) * sums[-1], side="right")
            centre = np.column_stack(np.unravel_index(np.minimum(at, len(sums) - 1), size))
            out.append(np.clip(centre - np.array(patch) // 2, 0, np.maximum(size - np.array(patch), 0)).astype(np.int32).tolist())
        return pd.Series(out)

    shape = F.struct(*(m[a].alias(a) for a in ("c", *AXES)))
    found = F.posexplode(F.pandas_udf(places, "array<array<int>>")(m["data"], shape, draws)).alias("patch_ord", "at")
    return df.select(key, found).select(key, "patch_ord", *(F.get("at", F.lit(d)).alias(o) for d, o in enumerate(("i0", "j0", "k0"))))


def scaled(index: list[Column], size: list[Column], factor: tuple[float, float, float]) -> tuple[list[Column], list[Column]]:
    """A patch's place and size on a grid that is finer or coarser by a factor; halves are rounded to even."""
    return tuple([F.bround(c * f).cast("int") for c, f in zip(part, factor, strict=True)] for part in (index, size))


def hann_window(patch: tuple) -> np.ndarray:
    one = [0.5 * (1 - np.cos(2 * math.pi * (np.arange(n) + 1) / (n + 1))) for n in patch]
    return one[0][:, None, None] * one[1][None, :, None] * one[2][None, None, :]


def put_together(patches: list[np.ndarray], places: np.ndarray, shape: tuple, patch: tuple, mode: str, overlap: tuple = (0, 0, 0)) -> np.ndarray:
    """A volume (C, I, J, K) from patches in their order; NaN where there is none."""
    channels = patches[0].shape[0]
    out, weight = np.zeros((channels, *shape)), np.zeros(shape)
    window = hann_window(patch) if mode == "hann" else np.ones(patch)
    for x, at in zip(patches, places, strict=True):
        lo = [o // 2 if mode == "crop" and a > 0 else 0 for o, a in zip(overlap, at, strict=True)]
        hi = [p - o // 2 if mode == "crop" and a + p < n else p for p, o, a, n in zip(patch, overlap, at, shape, strict=True)]
        inner = tuple(slice(a, b) for a, b in zip(lo, hi, strict=True))
        box = tuple(slice(a + p, a + q) for a, p, q in zip(at, lo, hi, strict=True))
        if mode == "crop":
            out[(slice(None), *box)], weight[box] = x[(slice(None), *inner)], 1
        else:
            out[(slice(None), *box)] += x * window
            weight[box] += window
    if mode == "hann":
        return np.where(weight > 0, out / np.maximum(weight, 1.0), np.nan)
    return np.where(weight > 0, out / np.where(weight > 0, weight, 1), np.nan)


MODES = ("average", "hann", "crop")


def assemble(patches: DataFrame, shape: tuple, patch: tuple, mode: str = "average", overlap: tuple = (0, 0, 0), keys: tuple = ("subject_id",), data: tuple = ("data",)) -> DataFrame:
    """keys and, for every column of data (an output of a model, say), the volume that its patches make up, as an array.

    Patches are dealt by volume, whole arrays at a time; a task holds the patches of one volume. Null where no patch lies.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    rows = patches.select(*keys, "patch_ord", "i0", "j0", "k0", *data)
    kept = pa.schema([(f"v{n}", pa.list_(pa.float64())) for n in range(len(data))])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("patch_ord")
        at = np.column_stack([t.column(c).to_numpy() for c in ("i0", "j0", "k0")])
        volumes = []
        for name in data:
            parts = [np.asarray(x.values).astype(float).reshape(-1, *patch) for x in t.column(name)]
            flat = put_together(parts, at, shape, patch, mode, overlap).ravel()
            values = pa.array(flat, mask=np.isnan(flat))
            volumes.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), values))
        return pa.table([*(t.column(k).slice(0, 1) for k in keys), *volumes], names=[*keys, *kept.names])

    kinds = dict(patches.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"v{n} array<double>" for n in range(len(data)))])
    return rows.groupBy(*keys).applyInArrow(run, schema).withColumnsRenamed({f"v{n}": name for n, name in enumerate(data)})


def aggregate_patches(patches: DataFrame, shape: tuple, patch: tuple, mode: str = "average", overlap: tuple = (0, 0, 0), keys: tuple = ("subject_id",)) -> DataFrame:
    """keys, p, v: overlapping patches of one channel put together, voxel by voxel."""
    whole = assemble(patches, shape, patch, mode, overlap, keys)
    return whole.select(*keys, F.posexplode("data").alias("p", "v")).where("v is not null")


def queue(patches: DataFrame, *, per_subject: int, buffer_subjects: int | None = None, max_length: int = 300, shuffle_subjects: bool = False, seed: int = 0, key: str = "subject_id") -> DataFrame:
    """Order of a bounded shuffle buffer: subjects fill it in order, a full buffer is shuffled and drained.

    Subjects come in the order of their keys or, shuffled, of a hash. A buffer is full with max_length patches or more, so it holds ceil(max_length / per_subject) subjects (or buffer_subjects).

    key, patch_ord, buffer, place: the first per_subject patches of each row, buffers of so many subjects, hash order inside.
    Buffers are numbered from the subject's rank, found in two levels (blocks of ids, then inside), not by one global sort.
    """
    buffer_subjects = buffer_subjects or max(math.ceil(max_length / per_subject), 1)
    few = patches.where(F.col("patch_ord") < per_subject)
    ranks = ranked(few.select(key).distinct(), key, seed=seed if shuffle_subjects else None).withColumnRenamed("rank", "_rank")
    rows = few.join(ranks, key).withColumn("buffer", F.floor(F.col("_rank") / buffer_subjects))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("patch_ord").cast("string")))
    return rows.select(key, "patch_ord", "buffer", (F.row_number().over(Window.partitionBy("buffer").orderBy(order, key, "patch_ord")) - 1).cast("long").alias("place"))
