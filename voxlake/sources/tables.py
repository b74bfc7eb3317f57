"""The driver's tables read as volumes: embeddings as images of 4 x 4 x 4 voxels with labels and a mask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import affine as A
from ..functions.image import image


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, cohort and the images t1 (scalar), seg (labels 0..2) and brain (mask); one row a subject."""
    e = table(spark, sf_dir, "embeddings")
    data = F.transform("embedding", lambda x: x.cast("double"))
    place = A.from_spacing([F.lit(1.0), F.lit(1.0), F.col("label") % 3 + 1], [F.col("label"), F.lit(0.0), F.lit(0.0)])
    rows = e.select(F.col("vec_id").alias("subject_id"), F.col("label").alias("cohort"), data.alias("d"), place.alias("a"))
    seg = F.transform("d", lambda x: F.when(x > 0.1, 2).when(x > 0, 1).otherwise(0))
    brain = F.transform("d", lambda x: (x > 0).cast("int"))
    return rows.select("subject_id", "cohort", *(image(1, 4, 4, 4, F.col("a"), d).alias(n) for n, d in (("t1", F.col("d")), ("seg", seg), ("brain", brain))))


def multichannel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers as images of 4 channels of 4 x 4 x 1."""
    s = subjects(spark, sf_dir)
    return s.select("subject_id", "cohort", image(4, 4, 4, 1, F.col("t1.affine"), F.col("t1.data")).alias("t1"))
