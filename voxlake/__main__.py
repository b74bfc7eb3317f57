"""Command line: python -m voxlake info FILE | convert IN OUT | transform PIPELINE.json IN OUT [--seed N]."""

from __future__ import annotations

import argparse
import json

import numpy as np

from .sources import backends, nifti


def _load(path: str):
    with open(path, "rb") as f:
        return backends.backend_of(path).load(f, None)


def _save(path: str, volume: np.ndarray, affine: np.ndarray) -> None:
    kind = np.dtype(volume.dtype).newbyteorder("=")
    volume = volume.astype(kind if kind.str[1:] in nifti.CODES.values() else np.float64)
    if path.endswith(".npy"):
        np.save(path, volume)
        return
    body = backends.write_nrrd(volume, affine, compress=True) if path.endswith(".nrrd") else nifti.encode(volume, affine, compress=path.endswith(".gz"))
    with open(path, "wb") as f:
        f.write(body)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="voxlake")
    commands = top.add_subparsers(dest="command", required=True)
    info = commands.add_parser("info")
    info.add_argument("file")
    convert = commands.add_parser("convert")
    transform = commands.add_parser("transform")
    transform.add_argument("pipeline")
    transform.add_argument("--seed", type=int, default=0)
    for c in (convert, transform):
        c.add_argument("source")
        c.add_argument("target")
    a = top.parse_args(argv)
    if a.command == "info":
        from .operators.volume import orientation

        with open(a.file, "rb") as f:
            h = backends.backend_of(a.file).head(f)
        affine = np.asarray(h["affine"], float)
        print(json.dumps({"shape": list(map(int, h["shape"])), "dtype": np.dtype(h["dtype"]).newbyteorder("=").name, "spacing": np.sqrt((affine[:3, :3] ** 2).sum(axis=0)).tolist(), "origin": affine[:3, 3].tolist(), "orientation": orientation(affine)}))
    elif a.command == "convert":
        _save(a.target, *_load(a.source))
    else:
        from pyspark.sql import SparkSession, functions as F

        from .plans.compose import from_json

        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        with open(a.pipeline) as f:
            steps = from_json(f.read())
        df = backends.scan(spark, a.source).select(F.lit("0").alias("subject_id"), F.col("image").alias("image"))
        x = steps(df, seed=a.seed).select("image").head()["image"]
        _save(a.target, np.array(x["data"]).reshape(x["c"], x["si"], x["sj"], x["sk"]), np.array(x["affine"]).reshape(4, 4))


if __name__ == "__main__":
    main()
