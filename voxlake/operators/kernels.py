"""Neighbourhood, interpolation, Fourier and component operators: NumPy kernels behind Arrow-batched pandas UDFs.

A kernel is a plain function of one volume (C, I, J, K) and numbers, testable without Spark; ``kernel`` wraps it as a column
function. Random operators take their numbers from ``rng.Draws`` of (seed, row key), so results do not depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.affine import euler_matrix
from ..functions.image import AXES, replace
from ..functions.rng import Draws


def kernel(f: Callable, img: Column, *params: Column, label: bool = False) -> Column:
    """f(volume, *params) -> volume of the same shape, as the data of img."""

    def run(data: pd.Series, shape: pd.DataFrame, *rest: pd.Series) -> pd.Series:
        sizes = shape.to_numpy()
        out = [np.asarray(f(np.array(d, dtype=float).reshape(s), *(r.iloc[n] for r in rest))).ravel() for n, (d, s) in enumerate(zip(data, sizes, strict=True))]
        return pd.Series([o.astype(np.int32) if label else o.astype(float) for o in out])

    shape = F.struct("c", *AXES) if isinstance(img, str) else F.struct(*(img[a].alias(a) for a in ("c", *AXES)))
    return replace(img, data=pandas_udf(run, "array<int>" if label else "array<double>")(img["data"], shape, *params))


def blur(x: np.ndarray, sigmas) -> np.ndarray:
    """Separable Gaussian, deviations in voxels; replicated border; axes with no deviation are left."""
    for d, s in enumerate(sigmas, 1):
        if s > 0:
            r = max(int(np.ceil(3 * s)), 1)
            t = np.arange(-r, r + 1)
            w = np.exp(-0.5 * (t / s) ** 2)
            w /= w.sum()
            n = x.shape[d]
            x = sum(wt * np.take(x, np.clip(np.arange(n) + o, 0, n - 1), axis=d) for o, wt in zip(t, w, strict=True))
    return x


def contour(x: np.ndarray) -> np.ndarray:
    """1 where one of the 26 neighbours is smaller; outside counts as -1, so faces are contour."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1), (1, 1)), constant_values=-1)
    si, sj, sk = x.shape[1:]
    low = np.min([p[:, a : a + si, b : b + sj, c : c + sk] for a in range(3) for b in range(3) for c in range(3)], axis=0)
    return (low != x).astype(int)


def components(mask: np.ndarray, full: bool = True) -> np.ndarray:
    """Connected components of a 3-D mask: 0 outside, else the least position of the component + 1. Labels spread until nothing changes."""
    at = np.where(mask, np.arange(mask.size).reshape(mask.shape) + 1, 0)
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0) and (full or abs(a) + abs(b) + abs(c) == 1)]
    pairs = []
    for d in steps:
        here = tuple(slice(max(-o, 0), n - max(o, 0)) for o, n in zip(d, mask.shape, strict=True))
        there = tuple(slice(max(o, 0), n - max(-o, 0)) for o, n in zip(d, mask.shape, strict=True))
        both = mask[here] & mask[there]
        pairs.append(np.column_stack([at[here][both], at[there][both]]))
    edges = np.concatenate(pairs)
    root = np.arange(mask.size + 1)
    while len(edges):
        a, b = root[edges[:, 0]], root[edges[:, 1]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    return root[at]


def keep_largest(x: np.ndarray, labels=None, background: float = 0, full: bool = True) -> np.ndarray:
    """Of every label the largest component stays (of equals the one with the first voxel); the rest becomes background."""
    if x.shape[0] != 1:
        raise RuntimeError("one channel is needed")
    v, out = x[0], x[0].copy()
    for label in np.unique(v[v != background]) if labels is None else labels:
        parts = components(v == label, full)
        names, counts = np.unique(parts[parts > 0], return_counts=True)
        if len(names):
            out[(v == label) & (parts != names[counts.argmax()])] = background
    return out[None]


def bias_field(shape, std: float, scale: float, draws: Draws, stream: str = "bias") -> np.ndarray:
    """exp of a smooth random field for every channel: normal values on a coarse grid, raised trilinearly to the volume."""
    if not 0 < scale <= 1:
        raise ValueError("scale must lie in (0, 1]")
    small = (shape[0], *(max(round(n * scale), 4) for n in shape[1:]))
    coarse = draws.normal(stream, int(np.prod(small))).reshape(small) * std
    for d, n in enumerate(shape[1:], 1):
        coarse = linear_axis(coarse, d, n)
    return np.exp(coarse)


def linear_axis(x: np.ndarray, d: int, n: int) -> np.ndarray:
    """Linear resampling of one axis, end voxels on end voxels."""
    old = x.shape[d]
    src = np.arange(n) * (old - 1) / (n - 1) if n > 1 else np.zeros(1)
    lo = np.floor(src).astype(int)
    hi = np.minimum(lo + 1, old - 1)
    w = (src - lo).reshape([-1 if e == d else 1 for e in range(x.ndim)])
    return np.take(x, lo, d) * (1 - w) + np.take(x, hi, d) * w


def add_bias(x: np.ndarray, key, std: float, scale: float, seed: int, inverse: bool = False) -> np.ndarray:
    field = bias_field(x.shape, std, scale, Draws(seed, key))
    return x / field if inverse else x * field


def along(n: int, axis: int, ndim: int = 4) -> list[int]:
    """The shape that lays n values along an axis."""
    return [n if d == axis else 1 for d in range(ndim)]


def ghosting(x: np.ndarray, num: int, axis: int, intensity: float, restore: float | None = None) -> np.ndarray:
    """Echoes along an axis: some of its frequencies lose a share, but for a band about 0. The other axes need no transform."""
    if not num or not intensity:
        return x
    n = x.shape[axis + 1]
    place = np.fft.fftshift(np.arange(n))  # the frequency at each place of the ordered spectrum
    loss = np.zeros(n)
    loss[place[:: max(n // num, 1)]] = intensity
    if restore:
        width = max(int(n * restore / 2), 1)
        loss[place[max(n // 2 - width, 0) : n // 2 + width]] = 0
    echo = np.fft.ifft(np.fft.fft(x, axis=axis + 1) * loss.reshape(along(n, axis + 1)), axis=axis + 1)
    return x - echo.real


def spike(x: np.ndarray, positions, intensity: float) -> np.ndarray:
    """Plane waves whose amplitude is the spectrum's peak times intensity; a position is a place in the ordered spectrum."""
    if not intensity or not len(positions):
        return x
    shape = x.shape[1:]
    wave = np.zeros(shape)
    for p in positions:
        phase = np.zeros(shape)
        for d, (q, n) in enumerate(zip(p, shape, strict=True)):
            phase = phase + ((int(q * n) % n - n // 2) * np.arange(n) / n).reshape(along(n, d, 3))
        wave += np.cos(2 * np.pi * phase)
    peak = np.abs(np.fft.fftn(x, axes=(1, 2, 3))).max(axis=(1, 2, 3))
    return x + peak[:, None, None, None] * (intensity / wave.size) * wave


def sample(x: np.ndarray, at: np.ndarray, order: int = 1, fill: float = 0.0) -> np.ndarray:
    """Values at voxel coordinates (..., 3): nearest, trilinear (outside counts as 0), or splines of orders 2 to 7, which need no fill;
    where less than half a voxel lies inside, fill."""
    if order > 1:
        return spline_sample(x, at, order)
    shape = np.array(x.shape[1:])
    if order == 0:
        i = np.rint(at).astype(int)
        ok = ((i >= 0) & (i < shape)).all(axis=-1)
        i = np.clip(i, 0, shape - 1)
        return np.where(ok, x[:, i[..., 0], i[..., 1], i[..., 2]], fill)
    lo = np.floor(at).astype(int)
    w = at - lo
    out, inside = np.zeros((x.shape[0], *at.shape[:-1])), np.zeros(at.shape[:-1])
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                i = lo + (a, b, c)
                ok = ((i >= 0) & (i < shape)).all(axis=-1)
                weight = np.prod(np.where((a, b, c), w, 1 - w), axis=-1) * ok
                j = np.clip(i, 0, shape - 1)
                out += weight * x[:, j[..., 0], j[..., 1], j[..., 2]]
                inside += weight
    fill = np.asarray(fill, dtype=float).reshape(-1, *[1] * (at.ndim - 1))  # one for all channels, or one a channel
    return np.where(inside > 0.5, out, fill) if fill.any() else out


#: Orders of interpolation by name; numbers 0 to 7 are taken as they are.
ORDERS = {"nearest": 0, "linear": 1, "quadratic": 2, "cubic": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7}


def order_of(name) -> int:
    order = ORDERS.get(name, name)
    if isinstance(order, bool) or not isinstance(order, int) or not 0 <= order <= 7:
        raise ValueError(f"unknown interpolation {name!r}")
    return order


def bspline(x: np.ndarray, order: int) -> np.ndarray:
    """The centred B-spline of an order, as a sum of truncated powers."""
    half = (order + 1) / 2
    total = sum((-1) ** j * math.comb(order + 1, j) * np.maximum(x + half - j, 0.0) ** order for j in range(order + 2))
    return np.where(np.abs(x) < half, total / math.factorial(order), 0.0)


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Indices beyond an end counted back from it, the end voxel twice."""
    i = np.mod(i, 2 * n)
    return np.minimum(i, 2 * n - 1 - i)


def spline_coefficients(x: np.ndarray, order: int) -> np.ndarray:
    """Coefficients whose splines pass through the values, axis by axis by a linear system of the axis' length."""
    reach = np.arange(-(order // 2), order // 2 + 1)
    weights = bspline(reach.astype(float), order)
    for d in range(1, 4):
        n = x.shape[d]
        system = np.zeros((n, n))
        for o, w in zip(reach, weights, strict=True):
            np.add.at(system, (np.arange(n), mirrored(np.arange(n) + o, n)), w)
        x = np.moveaxis(np.linalg.solve(system, np.moveaxis(x, d, 0).reshape(n, -1)).reshape(n, *np.delete(x.shape, d)), 0, d)
    return x


def spline_sample(x: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """B-spline interpolation of orders 2 to 7 at voxel coordinates (..., 3); 0 more than a twentieth of a voxel outside."""
    shape = x.shape[1:]
    coef = spline_coefficients(x.astype(float), order)
    first = np.floor(at - (order - 1) / 2).astype(int)
    taps, weights = [], []
    for d, n in enumerate(shape):
        place = first[..., d, None] + np.arange(order + 1)
        taps.append(mirrored(place, n))
        weights.append(bspline(at[..., d, None] - place, order))
    out = np.zeros((x.shape[0], *at.shape[:-1]))
    for a in range(order + 1):
        for b in range(order + 1):
            part = weights[0][..., a] * weights[1][..., b]
            for c in range(order + 1):
                out += part * weights[2][..., c] * coef[:, taps[0][..., a], taps[1][..., b], taps[2][..., c]]
    inside = ((at > -0.05) & (at < np.array(shape) - 0.95)).all(axis=-1)
    return np.where(inside, out, 0.0)


def grid(shape) -> np.ndarray:
    return np.stack(np.meshgrid(*(np.arange(n, dtype=float) for n in shape), indexing="ij"), axis=-1)


def affine_matrix(shape, affine, scales, degrees, translation, center: str = "image") -> np.ndarray:
    """World transform: rotation and scaling about the image's centre (or the world's origin), then a shift.

    An image of one slice stays in its plane.
    """
    if shape[-1] == 1:
        scales, degrees, translation = (*scales[:2], 1.0), (0.0, 0.0, degrees[2]), (*translation[:2], 0.0)
    a = np.array(affine, dtype=float).reshape(4, 4)
    c = a[:3, :3] @ ((np.array(shape) - 1) / 2) + a[:3, 3] if center == "image" else np.zeros(3)
    m = np.eye(4)
    m[:3, :3] = euler_matrix(degrees) @ np.diag(scales)
    m[:3, 3] = c - m[:3, :3] @ c + translation
    return m


def displacement(control: np.ndarray, shape) -> np.ndarray:
    """The displacements of control points raised to a grid of voxels."""
    for d, n in enumerate(shape):
        control = linear_axis(control, d, n)
    return control


def warp(x: np.ndarray, affine, matrix=None, out_shape=None, out_affine=None, control=None, order: int = 1, fill=0.0, affine_first: bool = True, label: bool = False) -> np.ndarray:
    """One resampling: output voxel -> world -> inverse world transform -> input voxel, with displacements in mm before or after.

    label: every label's share is interpolated and the largest wins.
    """
    a = np.array(affine, dtype=float).reshape(4, 4)
    b = a if out_affine is None else np.array(out_affine, dtype=float).reshape(4, 4)
    shape = tuple(out_shape or x.shape[1:])
    m = np.linalg.inv(a) @ (np.eye(4) if matrix is None else np.linalg.inv(matrix)) @ b
    at = grid(shape)
    if control is not None and not affine_first:
        at = at + displacement(control, shape) / np.sqrt((b[:3, :3] ** 2).sum(axis=0))
    at = at @ m[:3, :3].T + m[:3, 3]
    if control is not None and affine_first:
        at = at + displacement(control, shape) / np.sqrt((a[:3, :3] ** 2).sum(axis=0))
    return partial_volume(x, at, fill) if label else sample(x, at, order, fill)


def control_points(n: tuple, largest, locked: int, draws: Draws, stream: str = "control") -> np.ndarray:
    """Random displacements (mm) of a coarse grid; the outer layers stay."""
    if min(n) < 4:
        raise ValueError("at least 4 control points an axis are needed")
    out = (draws.uniform(stream, 3 * int(np.prod(n))).reshape(*n, 3) * 2 - 1) * largest
    for k in range(locked):
        for d in range(3):
            out[tuple(slice(None) if e != d else [k, n[d] - 1 - k] for e in range(3))] = 0
    return out


def rigid(x: np.ndarray, degrees, translation) -> np.ndarray:
    """A moved copy. Coordinates run from -1 to 1 on every axis, last axis first; the shift's i, j, k are taken in that order too."""
    size = np.array(x.shape[1:])
    half = np.maximum(size - 1, 1) / 2
    unit = (grid(size) - (size - 1) / 2) / half
    moved = unit[..., ::-1] @ euler_matrix(degrees).T + np.asarray(translation, float) / (size / 2)
    return sample(x, moved[..., ::-1] * half + (size - 1) / 2)


def motion(x: np.ndarray, degrees, translations) -> np.ndarray:
    """The frequencies of axis 0 in equal runs, the first from the image, each other from a moved copy."""
    n, runs = x.shape[1], len(degrees) + 1
    if n < runs:
        raise ValueError("too few slices for so many movements")
    owner = np.minimum(np.arange(n) // (n // runs), runs - 1)
    out = np.zeros(x.shape)
    for k, copy in enumerate([x, *(rigid(x, d, t) for d, t in zip(degrees, translations, strict=True))]):
        share = (owner == k).astype(float).reshape(along(n, 1))
        out += np.fft.ifft(np.fft.fft(copy, axis=1) * share, axis=1).real
    return out


def swap(x: np.ndarray, pairs, patch) -> np.ndarray:
    """Exchanges pairs of patches one after another."""
    x = x.copy()
    if any(p > s for p, s in zip(patch, x.shape[1:], strict=True)):
        raise ValueError("the patch is larger than the image")
    box = lambda at: (slice(None), *(slice(a, a + p) for a, p in zip(at, patch, strict=True)))
    for a, b in pairs:
        one = x[box(a)].copy()
        x[box(a)], x[box(b)] = x[box(b)], one
    return x


def swap_pairs(shape, patch, n: int, draws: Draws, stream: str = "swap") -> list:
    """Random pairs of patches; the second is drawn up to 100 times until it does not overlap the first, and taken then as it is."""
    top = np.array([s - p + 1 for s, p in zip(shape, patch, strict=True)])
    if (top < 1).any():
        raise ValueError("the patch is larger than the image")
    out = []
    for k in range(n):
        places = np.floor(draws.uniform(f"{stream}{k}", 303).reshape(101, 3) * top).astype(int)
        apart = (np.abs(places[1:] - places[0]) >= patch).any(axis=1)
        out.append((tuple(places[0].tolist()), tuple(places[1 + (int(apart.argmax()) if apart.any() else 99)].tolist())))
    return out


def pca(x: np.ndarray, n: int, whiten: bool = True, normalize: bool = True, values=(-2.3, 2.3), clip: bool = True) -> np.ndarray:
    """Channels to principal components; the largest loading of each is positive, so that signs are defined."""
    if n > x.shape[0]:
        raise ValueError("more components than channels")
    flat = x.reshape(x.shape[0], -1)
    centered = flat - flat.mean(axis=1, keepdims=True)
    val, vec = np.linalg.eigh(centered @ centered.T)
    order = np.argsort(-val)[:n]
    axes = vec[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(n)])
    scores = axes.T @ centered
    if whiten:
        scores /= np.maximum(np.sqrt(np.maximum(val[order], 0) / (flat.shape[1] - 1)), 1e-8)[:, None]
    if normalize:
        scores /= max(scores[0].std(ddof=1), 1e-8)
    scores = (scores - values[0]) / (values[1] - values[0])
    scores = np.clip(scores, 0, 1) if clip else scores
    return scores.reshape(n, *x.shape[1:])


def partial_volume(x: np.ndarray, at: np.ndarray, pad_label: float = 0) -> np.ndarray:
    """Label resampling: every label's share is interpolated, the largest wins; where labels cover less than half, the pad label."""
    labels = np.unique(x)
    shares = np.stack([sample((x == v).astype(float), at)[0] for v in labels])
    out = labels[shares.argmax(axis=0)]
    return np.where(shares.sum(axis=0) > 0.5, out, pad_label)[None]


def spaced_grid(shape, affine, spacing) -> tuple[tuple, np.ndarray]:
    """Shape and affine of a grid of another spacing about the same centre: floor(size * old / new) voxels an axis, at least 1; singleton axes stay."""
    n, m = np.array(shape), np.array(affine, dtype=float).reshape(4, 4)
    old = np.sqrt((m[:3, :3] ** 2).sum(axis=0))
    new = np.where(n == 1, old, spacing)
    size = np.maximum(np.floor(n * old / new + 1e-9), 1).astype(int)
    b = np.eye(4)
    b[:3, :3] = m[:3, :3] / old * new
    b[:3, 3] = m[:3, :3] @ ((n - 1) / 2) + m[:3, 3] - b[:3, :3] @ ((size - 1) / 2)
    return tuple(size.tolist()), b


def resample(img: Column, spacing, order: int = 1) -> Column:
    """To a new voxel spacing."""

    def run(data: pd.Series, shape: pd.DataFrame, affine: pd.Series) -> pd.DataFrame:
        rows = []
        for d, s, a in zip(data, shape.to_numpy(), affine, strict=True):
            x = np.array(d, dtype=float).reshape(s)
            size, b = spaced_grid(x.shape[1:], a, spacing)
            out = warp(x, a, out_shape=size, out_affine=b, order=order)
            rows.append([out.shape[0], *out.shape[1:], b.ravel(), out.ravel()])
        return pd.DataFrame(rows, columns=["c", *AXES, "affine", "data"])

    shape = F.struct(*(img[a].alias(a) for a in ("c", *AXES)))
    return pandas_udf(run, "c int, si int, sj int, sk int, affine array<double>, data array<double>")(img["data"], shape, img["affine"])
