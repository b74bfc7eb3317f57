"""Counter-based random numbers: a function of seed, stream and key only, so no result depends on partitions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F


def uniform(seed: int, stream: str, key: Column) -> Column:
    """In (0, 1): the first 32 bits of the MD5 of seed|stream|key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def normal(seed: int, stream: str, key: Column) -> Column:
    """Standard normal, by Box and Muller from two streams."""
    u, v = uniform(seed, stream + ".u", key), uniform(seed, stream + ".v", key)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)


def uniform_sql(seed: int, stream: str, key: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}', CAST({key} AS VARCHAR))), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def normal_sql(seed: int, stream: str, key: str) -> str:
    return f"(sqrt(-2.0 * ln({uniform_sql(seed, stream + '.u', key)})) * cos({2 * math.pi!r} * {uniform_sql(seed, stream + '.v', key)}))"


def choose(u: Column, values: list, weights: list[float] | None = None) -> Column:
    """The value whose share of the cumulative weights u falls into."""
    w = weights or [1.0] * len(values)
    if len(w) != len(values) or min(w) < 0 or not sum(w):
        raise ValueError("weights must be non-negative, as many as values, and not all 0")
    out, upto = F.lit(values[-1]), sum(w)
    for value, weight in zip(values[-2::-1], w[:0:-1], strict=True):
        upto -= weight
        out = F.when(u < upto / sum(w), F.lit(value)).otherwise(out)
    return out


# Numbers by the voxel: a 32-bit hash of the position and of a base that seed, stream and key give, the same as a column, in SQL and in NumPy.
_STEP, _FACTOR, _MOD = 2654435769, 73244475, 1 << 32


def base(seed, stream: str, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def voxel_uniform(start: Column, p: Column) -> Column:
    """In (0, 1): the number of position p after a base."""
    h = F.pmod(p.cast("bigint") * F.lit(_STEP) + start, F.lit(_MOD))
    for _ in range(2):
        h = F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(_FACTOR), F.lit(_MOD))
    return (h.bitwiseXOR(F.shiftright(h, 16)) + F.lit(0.5)) / F.lit(float(_MOD))


def voxel_normal(start: Column, other: Column, p: Column) -> Column:
    return F.sqrt(F.lit(-2.0) * F.ln(voxel_uniform(start, p))) * F.cos(F.lit(2 * math.pi) * voxel_uniform(other, p))


def voxel_uniform_sql(seed, stream: str, key: str, p: str) -> str:
    h = f"((CAST({p} AS BIGINT) * {_STEP} + CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}', CAST({key} AS VARCHAR))), 1, 8) AS BIGINT)) % {_MOD})"
    for _ in range(2):
        h = f"((xor({h}, {h} >> 16) * {_FACTOR}) % {_MOD})"
    return f"((xor({h}, {h} >> 16) + 0.5) / {float(_MOD)!r})"


def voxel_normal_sql(seed, stream: str, key: str, p: str) -> str:
    return f"(sqrt(-2.0 * ln({voxel_uniform_sql(seed, stream + '.u', key, p)})) * cos({2 * math.pi!r} * {voxel_uniform_sql(seed, stream + '.v', key, p)}))"


class Draws:
    """The same numbers in NumPy, for a seed and a key."""

    def __init__(self, seed, key):
        self.seed, self.key = seed, key

    def uniform(self, stream: str, n: int) -> np.ndarray:
        start = int(hashlib.md5(f"{self.seed}|{stream}|{self.key}".encode()).hexdigest()[:8], 16)
        h = np.arange(n, dtype=np.uint32) * np.uint32(_STEP) + np.uint32(start)
        for _ in range(2):
            h = (h ^ (h >> np.uint32(16))) * np.uint32(_FACTOR)
        return ((h ^ (h >> np.uint32(16))) + 0.5) / float(_MOD)

    def normal(self, stream: str, n: int) -> np.ndarray:
        return np.sqrt(-2 * np.log(self.uniform(stream + ".u", n))) * np.cos(2 * math.pi * self.uniform(stream + ".v", n))
