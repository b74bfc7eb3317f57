"""Parameter specifications of random transforms, compiled to columns.

A scalar is itself; (lo, hi) is uniform; {"choice": [...], "weights": [...]} is discrete; {"normal": [mean, std]} and
{"lognormal": [mean, std]} are distributions. For three axes: one spec for all (each axis is drawn by itself), three specs, or
six numbers (three ranges).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import rng


def draw(spec, seed: int, stream: str, key: Column) -> Column:
    if isinstance(spec, bool) or isinstance(spec, int | float):
        return F.lit(float(spec))
    if isinstance(spec, dict):
        if "choice" in spec:
            return rng.choose(rng.uniform(seed, stream, key), list(spec["choice"]), spec.get("weights"))
        kind, (a, b) = next(iter(spec.items()))
        z = rng.normal(seed, stream, key) * float(b) + float(a)
        return {"normal": z, "lognormal": F.exp(z)}[kind]
    if isinstance(spec, tuple | list) and len(spec) == 2:
        lo, hi = map(float, spec)
        if lo > hi:
            raise ValueError(f"empty range {spec}")
        return F.lit(lo) + (hi - lo) * rng.uniform(seed, stream, key)
    raise ValueError(f"invalid parameter {spec!r}")


def draw3(spec, seed: int, stream: str, key: Column) -> list[Column]:
    if isinstance(spec, tuple | list):
        if len(spec) == 6:
            spec = [spec[0:2], spec[2:4], spec[4:6]]
        if len(spec) == 3:
            return [draw(s, seed, f"{stream}.{d}", key) for d, s in enumerate(spec)]
        if len(spec) != 2:
            raise ValueError(f"1, 2, 3 or 6 values are needed, not {len(spec)}")
    return [draw(spec, seed, f"{stream}.{d}", key) for d in range(3)]


def non_negative(spec) -> None:
    values = spec if isinstance(spec, tuple | list) else [spec]
    if any(isinstance(v, int | float) and v < 0 for v in values):
        raise ValueError(f"negative value in {spec!r}")
