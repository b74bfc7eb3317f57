"""Intermediate tables in the folder that driver and executors share, and keys of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir, the folder that all executors share.

    Where that is unset, a local session (as in tests) takes one under the warehouse; any other raises.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


class Store:
    """Tables of one run; a lost executor costs no step that has been kept, and plans stay short."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.top, self.n = spark, shared_path(spark, kind), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """Keeps df and deletes all tables kept before, which nothing must read any more."""
        out, context = self.keep(df), self.spark.sparkContext
        for n in range(1, self.n):
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{n}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        return out


def text_hashes(text: Column) -> list[Column]:
    """128 bits of the text in two columns, h1 and h2; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("h1"), F.xxhash64(t, F.lit(1)).alias("h2")]


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A kept table as the small side of a join: broadcast up to so many rows (of a few numbers each), else left to sort and merge."""
    return F.broadcast(df) if df.count() <= rows else df
