"""Index rules of images: (C, I, J, K), axes are never dropped."""

from __future__ import annotations

import numpy as np


def normalize_index(item, ndim: int = 4) -> tuple[slice, ...]:
    """Exactly ndim slices from an integer, a slice, an Ellipsis or a tuple of these.

    An integer becomes a slice of one element (-1 the last), one Ellipsis stands for the axes left out, missing trailing axes are whole.
    """
    items = item if isinstance(item, tuple) else (item,)
    dots = [k for k, x in enumerate(items) if x is Ellipsis]
    if len(dots) > 1:
        raise IndexError("only one ellipsis is allowed")
    if dots:
        k = dots[0]
        items = (*items[:k], *[slice(None)] * max(ndim - len(items) + 1, 0), *items[k + 1 :])
    if len(items) > ndim:
        raise IndexError(f"at most {ndim} indices, not {len(items)}")
    out = []
    for x in items:
        if isinstance(x, bool) or not isinstance(x, int | np.integer | slice):
            raise TypeError(f"an index of type {type(x).__name__} is not understood")
        out.append(x if isinstance(x, slice) else slice(x, None if x == -1 else x + 1))
    return (*out, *[slice(None)] * (ndim - len(out)))


def index_affine(affine: np.ndarray, index: tuple[slice, ...], shape: tuple[int, ...]) -> np.ndarray:
    """The affine of the voxels that three spatial slices leave: the first of them is the origin, steps stretch the columns."""
    out = np.array(affine, dtype=float).reshape(4, 4)
    first, step = zip(*(s.indices(n)[::2] for s, n in zip(index, shape, strict=True)), strict=True)
    out[:3, 3] += out[:3, :3] @ np.array(first, float)
    out[:3, :3] = out[:3, :3] * step
    return out


def parse_index(text: str) -> tuple:
    """The index that a text such as ``:, 1:3, ..., -1`` writes."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        if part == "...":
            out.append(Ellipsis)
        elif ":" in part:
            out.append(slice(*(int(x) if x.strip() else None for x in part.split(":"))))
        else:
            out.append(int(part))
    return tuple(out)
