"""Subjects stacked into batches and taken apart again, and checks that the images of a subject agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import affine as A
from ..functions.image import AXES


def ranked(ids: DataFrame, key: str, block: int = 1024, seed: int | None = None) -> DataFrame:
    """key and its rank among all, in two levels (blocks of ids, then inside), not by one global sort; key is a distinct whole number.

    With a seed the order is that of a hash (the first 32 bits of an MD5), and a block a run of its values.
    """
    order = F.col(key) if seed is None else F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("subject"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    blocks = ids.withColumn("_o", order).withColumn("_b", F.floor(F.col("_o") / (block if seed is None else 1 << 22)))
    before = blocks.groupBy("_b").agg(F.count("*").alias("_n"))
    before = before.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_o", key)) - 1
    return blocks.join(before, "_b").select(key, (F.col("_before") + inside).alias("rank"))


def stack(df: DataFrame, names: list[str], size: int, *, key: str = "subject_id") -> DataFrame:
    """batch, n and for every image an array of the images of up to size subjects in the order of their keys (keys: array too).

    Images of one batch must have one shape; others raise.
    """
    numbered = df.join(ranked(df.select(key), key), key).withColumn("batch", F.floor(F.col("rank") / size))
    rows = numbered.groupBy("batch").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), *names))).alias("rows"))
    part = lambda n: lambda r: r[n]
    shape = lambda n: lambda r: F.struct(*(r[n][a].alias(a) for a in ("c", *AXES)))
    checked = F.col("rows")
    for n in names:
        kinds = F.size(F.array_distinct(F.transform("rows", shape(n))))
        checked = F.when(kinds > 1, F.raise_error(F.lit(f"images of several shapes in a batch: {n}"))).otherwise(checked)
    rows = rows.withColumn("rows", checked)
    return rows.select("batch", "n", F.transform("rows", part("key")).alias("keys"), *(F.transform("rows", part(n)).alias(n) for n in names))


def unstack(batches: DataFrame, names: list[str], *, key: str = "subject_id") -> DataFrame:
    """The subjects of stack, with their batch and their place in it."""
    zipped = F.arrays_zip(F.col("keys").alias("key"), *(F.col(n).alias(n) for n in names))
    return batches.select("batch", F.posexplode(zipped).alias("place", "e")).select(F.col("e.key").alias(key), "batch", "place", *(F.col(f"e.{n}").alias(n) for n in names))


def consistent(names: list[str], attribute: str = "spacing", *, rtol: float = 1e-6, atol: float = 1e-6) -> Column:
    """Whether images of a subject agree in their shape, spacing, origin or affine."""
    of = {
        "shape": lambda x: [x[a].cast("double") for a in AXES],
        "spacing": lambda x: A.spacing(x["affine"]),
        "origin": lambda x: A.origin(x["affine"]),
        "affine": lambda x: [F.get(x["affine"], F.lit(k)) for k in range(16)],
    }
    if attribute not in of:
        raise ValueError(f"unknown attribute {attribute!r}")
    first, *others = (of[attribute](F.col(n)) for n in names)
    out = F.lit(True)
    for other in others:
        for a, b in zip(first, other, strict=True):
            out = out & (F.abs(a - b) <= atol + rtol * F.abs(b))
    return out
