"""Image structs and index arithmetic as column expressions.

A subject is a row; each of its images is a struct column ``STRUCT<c, si, sj, sk, affine, data>`` with the voxels
flattened in (C, I, J, K) order. Scalar images hold floating-point data, label maps integers, so the schema alone says
which transform applies to which column. Everything here is evaluated inside the row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, functions as F, types as T

AXES = ("si", "sj", "sk")


def image(c, si, sj, sk, affine: Column, data: Column) -> Column:
    as_int = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return F.struct(as_int(c).alias("c"), as_int(si).alias("si"), as_int(sj).alias("sj"), as_int(sk).alias("sk"), affine.alias("affine"), data.alias("data"))


def replace(img: Column, **fields: Column) -> Column:
    """The struct with some fields changed."""
    return image(*(fields.get(k, img[k]) for k in ("c", *AXES, "affine", "data")))


def is_image(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and set(kind.names) >= {"c", "si", "sj", "sk", "affine", "data"}


def image_columns(df: DataFrame, kind: str | None = None) -> list[str]:
    """Names of image columns; kind: scalar (floating-point data) or label (integer data)."""
    out = []
    for f in df.schema.fields:
        if is_image(f.dataType):
            element = f.dataType["data"].dataType.elementType
            is_label = isinstance(element, T.IntegralType)
            if kind is None or (kind == "label") == is_label:
                out.append(f.name)
    return out


def size(img: Column) -> Column:
    return img["c"] * img["si"] * img["sj"] * img["sk"]


def position(c: Column, i: Column, j: Column, k: Column, si: Column, sj: Column, sk: Column) -> Column:
    return ((c * si + i) * sj + j) * sk + k


def gather(img: Column, shape: tuple, source: Callable, fill: Column | None = None) -> Column:
    """Data of the given (c, si, sj, sk) shape; source(c, i, j, k) is the position in img's data, null where there is none."""
    c, si, sj, sk = (v if isinstance(v, Column) else F.lit(v) for v in shape)
    n = c * si * sj * sk

    def value(p: Column) -> Column:
        at = source(F.floor(p / (si * sj * sk)), F.floor(p / (sj * sk)) % si, F.floor(p / sk) % sj, p % sk)
        got = F.get(img["data"], at.cast("int"))
        return got if fill is None else F.coalesce(got, fill)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), value))


def ratio(img: Column) -> Column:
    """Voxel spacing: norms of the affine's columns."""
    a = img["affine"]
    return F.array(*(F.sqrt(sum((F.get(a, F.lit(4 * r + c)) * F.get(a, F.lit(4 * r + c)) for r in range(3)), F.lit(0.0))) for c in range(3)))


def mean(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda s, x: s + x) / F.size(data)


def stddev(data: Column, center: Column) -> Column:
    """Unbiased; null for fewer than two values."""
    n = F.size(data)
    return F.when(n > 1, F.sqrt(F.aggregate(data, F.lit(0.0), lambda s, x: s + (x - center) * (x - center)) / F.nullif(n - 1, F.lit(0))))


def quantile(data: Column, q: float | Column) -> Column:
    """Exact, with linear interpolation between the sorted values."""
    if isinstance(q, float | int) and not 0 <= q <= 1:
        raise ValueError(f"a quantile lies in [0, 1], not at {q}")
    return _quantile_sorted(F.array_sort(data), q)


def _quantile_sorted(v: Column, q: float | Column) -> Column:
    at = (F.size(v) - 1) * (q if isinstance(q, Column) else F.lit(float(q)))
    lo = F.floor(at)
    a, b = F.get(v, lo.cast("int")), F.get(v, F.least(lo + 1, F.size(v) - 1).cast("int"))
    return a + (b - a) * (at - lo)


def quantiles(data: Column, qs: list[float]) -> Column:
    """An array of quantiles, sorting once."""
    return F.get(F.transform(F.array(F.array_sort(data)), lambda v: F.array(*(_quantile_sorted(v, q) for q in qs))), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def voxels(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """(keys, p, v): one row for each voxel of an image column."""
    return df.select(*keys, F.posexplode(F.col(name)["data"]).alias("p", "v"))


def bound(f: Callable) -> Callable:
    """An operator whose image is evaluated once for the row, however often the operator's expression names it."""

    @wraps(f)
    def once(img: Column, *args, **params) -> Column:
        return let(img, lambda x: f(x, *args, **params))

    return once
