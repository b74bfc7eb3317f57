"""Spatial operators that move voxels by index arithmetic, evaluated inside the row."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..functions import affine as A
from ..functions.image import bound, AXES, gather, image, let, mean, position, quantile, replace

PAD_MODES = ("constant", "reflect", "replicate", "circular", "mean", "median", "minimum")


def six(spec: int | tuple) -> tuple[int, ...]:
    """int, 3 or 6 numbers -> (i0, i1, j0, j1, k0, k1)."""
    v = (spec,) * 6 if isinstance(spec, int) else tuple(x for x in spec for _ in range(2)) if len(spec) == 3 else tuple(spec)
    if len(v) != 6 or min(v) < 0:
        raise ValueError("1, 3 or 6 non-negative numbers are needed")
    return v


@bound
def crop(img: Column, cropping: int | tuple) -> Column:
    i0, i1, j0, j1, k0, k1 = six(cropping)
    shape = (img["c"], img["si"] - i0 - i1, img["sj"] - j0 - j1, img["sk"] - k0 - k1)
    data = gather(img, shape, lambda c, i, j, k: position(c, i + i0, j + j0, k + k0, img["si"], img["sj"], img["sk"]))
    data = F.coalesce(data, F.raise_error(F.lit("nothing is left after cropping")))
    return image(*shape, A.shifted(img["affine"], F.lit(i0), F.lit(j0), F.lit(k0)), data)


@bound
def pad(img: Column, padding: int | tuple, mode: str = "constant", fill: float = 0) -> Column:
    if mode not in PAD_MODES:
        raise ValueError(f"unknown padding mode {mode!r}")
    lo = six(padding)[::2]
    hi = six(padding)[1::2]
    shape = (img["c"], *(img[a] + lo[d] + hi[d] for d, a in enumerate(AXES)))

    def index(q: Column, n: Column) -> Column:
        if mode == "replicate":
            return F.greatest(F.lit(0), F.least(q, n - 1))
        if mode == "circular":
            return F.pmod(q, n)
        if mode == "reflect":
            return F.when(n > 1, let(F.pmod(q, F.greatest(2 * (n - 1), F.lit(1))), lambda m: F.least(m, 2 * (n - 1) - m))).otherwise(0)
        return F.when((q >= 0) & (q < n), q)

    value = {"mean": lambda: mean(img["data"]), "median": lambda: quantile(img["data"], 0.5), "minimum": lambda: F.array_min(img["data"])}.get(mode, lambda: F.lit(fill))()
    source = lambda c, i, j, k: position(c, *(index(x - lo[d], img[AXES[d]]) for d, x in enumerate((i, j, k))), img["si"], img["sj"], img["sk"])
    data = let(value, lambda v: gather(img, shape, source, v))
    return image(*shape, A.shifted(img["affine"], *(F.lit(-x) for x in lo)), data)


def split_difference(shape: tuple[int, int, int], target: tuple) -> tuple[tuple, tuple]:
    """Paddings and croppings (6 numbers each) that lead to the target; None keeps an axis. The first side gets the larger half."""
    pads, crops = [], []
    for n, t in zip(shape, target, strict=True):
        d = 0 if t is None else t - n
        for out, x in ((pads, max(d, 0)), (crops, max(-d, 0))):
            out += [math.ceil(x / 2), x // 2]
    return tuple(pads), tuple(crops)


def crop_or_pad(img: Column, shape: tuple[int, int, int], target: tuple, mode: str = "constant", fill: float = 0) -> Column:
    """To the target shape around the centre; shape is that of the images, all equal."""
    pads, crops = split_difference(shape, target)
    out = pad(img, pads, mode, fill) if any(pads) else img
    return crop(out, crops) if any(crops) else out


def multiple_shape(shape: tuple[int, int, int], multiple: int | tuple, method: str = "pad") -> tuple[int, ...]:
    m = (multiple,) * 3 if isinstance(multiple, int) else multiple
    return tuple(max(math.ceil(n / k) * k if method == "pad" else n // k * k, 1) for n, k in zip(shape, m, strict=True))


@bound
def flip(img: Column, axes: tuple[int, ...] = (0,), when: Column | None = None) -> Column:
    """Reverses the data along axes; the affine stays."""
    turn = lambda d, x: img[AXES[d]] - 1 - x if d in axes else x
    data = gather(img, (img["c"], *(img[a] for a in AXES)), lambda c, i, j, k: position(c, turn(0, i), turn(1, j), turn(2, k), img["si"], img["sj"], img["sk"]))
    return replace(img, data=data if when is None else F.when(when, data).otherwise(img["data"]))


def _turned(img: Column, d: int):
    """The affine with axis d reversed: the origin moves to the other end, the column changes its sign."""

    def turn(a: Column) -> Column:
        moved = A.apply(a, *((img[AXES[d]] - 1 if x == d else F.lit(0)) for x in range(3)))
        return F.array(*(moved[r] if c == 3 and r < 3 else -A.at(a, r, c) if c == d and r < 3 else A.at(a, r, c) for r in range(4) for c in range(4)))

    return turn


@bound
def permute(img: Column, order: tuple[int, int, int], flips: tuple[int, ...] = ()) -> Column:
    """New axis d is the old axis order[d]; old axes in flips are reversed. The affine follows."""
    a = img["affine"]
    for d in flips:
        a = let(a, _turned(img, d))
    a = let(a, lambda m: F.array(*(A.at(m, r, order[c] if c < 3 else 3) for r in range(4) for c in range(4))))
    shape = (img["c"], *(img[AXES[d]] for d in order))

    def source(c, i, j, k):
        old = [None] * 3
        for new, d in zip((i, j, k), order, strict=True):
            old[d] = img[AXES[d]] - 1 - new if d in flips else new
        return position(c, *old, img["si"], img["sj"], img["sk"])

    return image(*shape, a, gather(img, shape, source))


@bound
def transpose(img: Column) -> Column:
    return permute(img, (2, 1, 0))


@bound
def reorient(img: Column, source: str, target: str = "RAS") -> Column:
    """From one anatomical orientation to another: flips, then a permutation."""
    order, signs = A.axis_mapping(source, target)
    return permute(img, tuple(order), tuple(d for d, s in zip(order, signs, strict=True) if s < 0))


def to_reference_space(img: Column, reference: Column) -> Column:
    """The affine that gives img the field of view and centre of the reference."""
    ref = reference["affine"]
    scale = [reference[a] / img[a] for a in AXES]
    center = A.apply(ref, *((reference[a] - 1) / 2 for a in AXES))
    m = [[A.at(ref, r, c) * scale[c] for c in range(3)] for r in range(3)]
    shift = [center[r] - sum((m[r][c] * ((img[AXES[c]] - 1) / 2) for c in (1, 2)), m[r][0] * ((img["si"] - 1) / 2)) for r in range(3)]
    return replace(img, affine=F.array(*(v for r in range(3) for v in (*m[r], shift[r])), *map(F.lit, (0.0, 0.0, 0.0, 1.0))))


def resample_axis(img: Column, d: int, n: Column, lower, upper=None, weight=None) -> Column:
    """Data and size of one axis replaced: value(lower) + (value(upper) - value(lower)) * weight, each a function of the new index."""
    shape = [img["c"], *(img[a] for a in AXES)]
    shape[d + 1] = n
    old = [img[a] for a in AXES]
    put = lambda f: lambda c, *x: position(c, *(f(x[e]) if e == d else x[e] for e in range(3)), *old)
    low = gather(img, tuple(shape), put(lower))
    if upper is not None:
        high = gather(img, tuple(shape), put(upper))
        at = (lambda p: F.floor(p / (shape[2] * shape[3])) % shape[1], lambda p: F.floor(p / shape[3]) % shape[2], lambda p: p % shape[3])[d]
        low = F.transform(F.arrays_zip(low.alias("a"), high.alias("b")), lambda x, p: x["a"] + (x["b"] - x["a"]) * weight(at(p)))
    return image(*shape, img["affine"], low)


def _nearest(img: Column, d: int, n: Column) -> Column:
    old = img[AXES[d]]
    return resample_axis(img, d, n, lambda x: F.least(F.floor(x * old / n), old - 1))


def _linear(img: Column, d: int, n: Column) -> Column:
    """End voxels on end voxels."""
    old = img[AXES[d]]
    src = lambda x: F.when(n > 1, x * (old - 1) / F.nullif(n - 1, F.lit(0))).otherwise(0.0)
    lo = lambda x: F.floor(src(x))
    return resample_axis(img, d, n, lo, lambda x: F.least(lo(x) + 1, old - 1), lambda x: src(x) - lo(x))


@bound
def resize(img: Column, target: tuple[int, int, int], interpolation: str = "linear") -> Column:
    """To the target shape; the affine's columns follow, the origin stays."""
    a = img["affine"]
    scale = [img[x] / t for x, t in zip(AXES, target, strict=True)]
    out = img
    step = bound(lambda x, d, t: (_linear if interpolation == "linear" else _nearest)(x, d, F.lit(t)))
    for d, t in enumerate(target):
        out = step(out, d, t)
    return replace(out, affine=F.array(*(A.at(a, r, c) * scale[c] if c < 3 and r < 3 else A.at(a, r, c) for r in range(4) for c in range(4))))


@bound
def anisotropy(img: Column, axis: int, factor: float, interpolation: str = "linear") -> Column:
    """Fewer slices along an axis (nearest), then as many as before (linear or nearest)."""
    n = img[AXES[axis]]
    fewer = F.greatest(F.lit(1), F.bround(n / factor)).cast("int")
    low = let(img, lambda x: _nearest(x, axis, fewer))
    return let(low, lambda x: (_linear if interpolation == "linear" else _nearest)(x, axis, n))


@bound
def border_mean(img: Column) -> Column:
    """Mean of the six faces of channel 0; voxels on edges and corners count once for each face."""
    si, sj, sk = (img[a] for a in AXES)

    def add(acc: Column, e: Column) -> Column:
        p, x = e["p"], e["x"]
        ends = [(F.floor(p / (sj * sk)) % si, si), (F.floor(p / sk) % sj, sj), (p % sk, sk)]
        m = sum(((v == 0).cast("int") + (v == n - 1).cast("int") for v, n in ends[1:]), (ends[0][0] == 0).cast("int") + (ends[0][0] == si - 1).cast("int"))
        return F.struct((acc["s"] + m * x).alias("s"), (acc["n"] + m).alias("n"))

    first = F.slice(img["data"], F.lit(1), (si * sj * sk).cast("int"))
    pairs = F.transform(first, lambda x, p: F.struct(x.cast("double").alias("x"), p.alias("p")))
    return F.aggregate(pairs, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), add, lambda a: a["s"] / a["n"])
