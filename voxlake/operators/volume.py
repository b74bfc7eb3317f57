"""Every transform as a function of one subject in NumPy, and its undoing from what was recorded.

``forward(subject, p)`` changes the chosen images of a subject in place; p holds its parameters, already drawn. What it puts into
``subject.notes`` joins the parameters in the history, so ``undo(subject, p)`` needs nothing but the record.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from ..functions.affine import LETTERS, axis_mapping
from ..functions.rng import Draws
from ..functions.slicing import index_affine, normalize_index, parse_index
from . import kernels as kn
from .intensity import QUANTILES
from .spatial import multiple_shape, six, split_difference


@dataclass
class Volume:
    data: np.ndarray  # (C, I, J, K)
    affine: np.ndarray  # 4 x 4
    label: bool

    @property
    def spacing(self) -> np.ndarray:
        return np.sqrt((self.affine[:3, :3] ** 2).sum(axis=0))

    @property
    def shape(self) -> tuple:
        return self.data.shape[1:]

    def move_origin(self, voxel) -> None:
        self.affine = self.affine.copy()
        self.affine[:3, 3] += self.affine[:3, :3] @ np.asarray(voxel, float)


@dataclass
class Subject:
    images: dict[str, Volume]
    chosen: list[str] = field(default_factory=list)
    notes: dict = field(default_factory=dict)

    def each(self) -> Iterator[tuple[str, Volume]]:
        return ((n, self.images[n]) for n in self.chosen if n in self.images)

    def need(self, name: str) -> Volume:
        if name not in self.images:
            raise KeyError(f"the subject has no image {name!r}")
        return self.images[name]


def draws(p: dict) -> Draws:
    return Draws(*p["draw"])


def sample(spec, u: float) -> float:
    """A number of a specification (a number or a range) for a uniform u."""
    return float(spec[0] + (spec[1] - spec[0]) * u) if isinstance(spec, tuple | list) else float(spec)


def sample3(spec, u: np.ndarray) -> list[float]:
    """Three numbers: one specification for all axes, three, or three ranges in six numbers."""
    if isinstance(spec, tuple | list) and len(spec) == 6:
        spec = [spec[0:2], spec[2:4], spec[4:6]]
    each = spec if isinstance(spec, tuple | list) and len(spec) == 3 else [spec] * 3
    return [sample(e, v) for e, v in zip(each, u, strict=True)]


# --- intensity ---
def masked(s: Subject, x: np.ndarray, how) -> np.ndarray:
    """The values where a mask (an image's name, or a function of the values) is set; all of them if there are none."""
    if how is None:
        return x.ravel()
    inside = how(x) if callable(how) else np.broadcast_to(s.need(how).data != 0, x.shape)
    return x[inside] if inside.any() else x.ravel()


def clamp(s: Subject, p: dict) -> None:
    for _, v in s.each():
        v.data = np.clip(v.data, p["out_min"], p["out_max"])


def gamma(s: Subject, p: dict) -> None:
    for _, v in s.each():
        v.data = np.sign(v.data) * np.abs(v.data) ** math.exp(p["log_gamma"])


def normalize(s: Subject, p: dict) -> None:
    for n, v in s.each():
        if p["in_min"] is not None and p["in_max"] is not None:
            lo, hi = p["in_min"], p["in_max"]
        else:
            lo, hi = np.quantile(masked(s, v.data, p["mask"]), [p["percentile_low"] / 100, p["percentile_high"] / 100]).tolist()
        if hi == lo:
            warnings.warn(f"all values of {n!r} are equal; it stays as it is", stacklevel=2)
            continue
        s.notes.setdefault("ranges", {})[n] = [lo, hi]
        v.data = (np.clip(v.data, lo, hi) - lo) / (hi - lo) * (p["out_max"] - p["out_min"]) + p["out_min"]


def un_normalize(s: Subject, p: dict) -> None:
    for n, v in s.each():
        if n in p.get("ranges", {}) and p["out_max"] != p["out_min"]:
            lo, hi = p["ranges"][n]
            v.data = (v.data - p["out_min"]) / (p["out_max"] - p["out_min"]) * (hi - lo) + lo


def standardize(s: Subject, p: dict) -> None:
    for n, v in s.each():
        values = masked(s, v.data, p["mask"])
        mean, std = float(values.mean()), float(values.std(ddof=1)) if values.size > 1 else 0.0
        if not std > 0:
            raise RuntimeError("standard deviation is 0")
        s.notes.setdefault("stats", {})[n] = [mean, std]
        v.data = (v.data - mean) / std


def un_standardize(s: Subject, p: dict) -> None:
    for n, v in s.each():
        if n in p["stats"]:
            v.data = v.data * p["stats"][n][1] + p["stats"][n][0]


def mask(s: Subject, p: dict) -> None:
    how = p["mask"]
    for _, v in s.each():
        inside = how(v.data) if callable(how) else np.isin(s.need(how).data, p["labels"]) if p["labels"] else s.need(how).data != 0
        v.data = np.where(inside, v.data, p["outside"])


def noise(s: Subject, p: dict) -> None:
    for n, v in s.each():
        one, two = (draws(p).normal(f"noise{k}.{n}", v.data.size).reshape(v.data.shape) * p["std"] + p["mean"] if k == 1 or p["rician"] else None for k in (1, 2))
        v.data = np.hypot(v.data + one, two) if p["rician"] else v.data + one


def bias(s: Subject, p: dict, sign: int = 1) -> None:
    for n, v in s.each():
        if p["std"]:
            v.data = v.data * kn.bias_field(v.data.shape, p["std"], p["scale"], draws(p), f"bias.{n}") ** sign


def blur(s: Subject, p: dict) -> None:
    for _, v in s.each():
        v.data = kn.blur(v.data, np.array(p["std"]) / v.spacing)


def histogram(s: Subject, p: dict) -> None:
    marks, qs = np.array(p["landmarks"], float), p["quantiles"] or QUANTILES
    if len(marks) != len(qs):
        raise ValueError("as many landmarks as quantiles are needed")
    for _, v in s.each():
        x = np.quantile(v.data, qs)
        step = np.diff(x)
        slope = np.where(np.abs(step) < 1e-5, 0.0, np.diff(marks) / np.where(step == 0, 1, step))
        seg = np.searchsorted(x[1:-1], v.data.ravel(), side="left")
        v.data = (slope[seg] * v.data.ravel() + (marks[:-1] - slope * x[:-1])[seg]).reshape(v.data.shape)


def ghosting(s: Subject, p: dict) -> None:
    for _, v in s.each():
        v.data = kn.ghosting(v.data, round(p["num_ghosts"]), int(p["axes"]), p["intensity"], p["restore"])


def spike(s: Subject, p: dict) -> None:
    places = draws(p).uniform("spike", 3 * max(round(p["num_spikes"]), 0)).reshape(-1, 3)
    for _, v in s.each():
        v.data = kn.spike(v.data, places, p["intensity"])


def motion(s: Subject, p: dict) -> None:
    n = round(p["num_transforms"])
    u = draws(p).uniform("motion", 6 * n).reshape(n, 6)
    degrees, shifts = ([sample3(p[k], row[a : a + 3]) for row in u] for k, a in (("degrees", 0), ("translation", 3)))
    for _, v in s.each():
        v.data = kn.motion(v.data, degrees, shifts)


def swap(s: Subject, p: dict) -> None:
    patch = (p["patch_size"],) * 3 if isinstance(p["patch_size"], int) else tuple(p["patch_size"])
    for n, v in s.each():
        pairs = kn.swap_pairs(v.shape, patch, max(1, round(p["num_iterations"])), draws(p))
        s.notes["pairs"] = pairs
        v.data = kn.swap(v.data, pairs, patch)


def pca(s: Subject, p: dict) -> None:
    for _, v in s.each():
        v.data = kn.pca(v.data, p["num_components"], p["whiten"], p["normalize"], p["values_range"], p["clip"])


def labels_to_image(s: Subject, p: dict) -> None:
    names = [n for n, v in s.images.items() if v.label and p["label_key"] in (None, n)]
    if not names:
        raise KeyError("no label map to make an image of")
    seg, d = s.images[names[0]], draws(p)
    labels = np.unique(seg.data[0])
    u = d.uniform("tissue", 2 * len(labels)).reshape(-1, 2)
    z = d.normal("tissue.noise", seg.data[0].size).reshape(seg.shape)
    out = np.zeros(seg.shape)
    for k, label in enumerate(labels.tolist()):
        if label == 0 and p["ignore_background"]:
            continue
        spec = lambda name, k=k: p[name][k] if p[name] is not None and k < len(p[name]) else p[f"default_{name}"]
        here = seg.data[0] == label
        out[here] = sample(spec("mean"), u[k, 0]) + abs(sample(spec("std"), u[k, 1])) * z[here]
    s.images[p["image_key"]] = Volume(out[None], seg.affine, False)


# --- labels ---
def remap(s: Subject, p: dict) -> None:
    table = {int(k): v for k, v in p["remapping"].items()}
    for _, v in s.each():
        out = v.data.copy()
        for old, new in table.items():
            out[v.data == old] = new
        v.data = out


def un_remap(s: Subject, p: dict) -> None:
    remap(s, {"remapping": {v: int(k) for k, v in p["remapping"].items()}})


def remove(s: Subject, p: dict) -> None:
    for _, v in s.each():
        v.data = np.where(np.isin(v.data, p["labels"]), p["background"], v.data)


def sequential(s: Subject, p: dict) -> None:
    for n, v in s.each():
        labels, back = np.unique(v.data, return_inverse=True)
        s.notes.setdefault("tables", {})[n] = labels.tolist()
        v.data = back.reshape(v.data.shape)


def un_sequential(s: Subject, p: dict) -> None:
    for n, v in s.each():
        v.data = np.array(p["tables"][n])[v.data.astype(int)]


def one_hot(s: Subject, p: dict) -> None:
    for _, v in s.each():
        classes = p["num_classes"] if p["num_classes"] > 0 else int(v.data[0].max()) + 1
        v.data = (v.data[:1] == np.arange(classes).reshape(-1, 1, 1, 1)).astype(v.data.dtype)


def un_one_hot(s: Subject, p: dict) -> None:
    for _, v in s.each():
        v.data = v.data.argmax(axis=0)[None].astype(v.data.dtype)


def contour(s: Subject, p: dict) -> None:
    for _, v in s.each():
        v.data = kn.contour(v.data)


def keep_largest(s: Subject, p: dict) -> None:
    for _, v in s.each():
        v.data = kn.keep_largest(v.data, p["labels"], p["background"], p["fully_connected"])


# --- spatial: index moves ---
def cropped(v: Volume, by: tuple) -> None:
    ends = [n - b for n, b in zip(v.shape, by[1::2], strict=True)]
    if any(a >= e for a, e in zip(by[::2], ends, strict=True)):
        raise ValueError("nothing is left after cropping")
    v.data = v.data[(slice(None), *(slice(a, e) for a, e in zip(by[::2], ends, strict=True)))]
    v.move_origin(by[::2])


def padded(v: Volume, by: tuple, mode: str, fill: float) -> None:
    width = [(0, 0), *zip(by[::2], by[1::2], strict=True)]
    numpy_mode = {"reflect": "reflect", "replicate": "edge", "circular": "wrap"}.get(mode)
    if numpy_mode:
        v.data = np.pad(v.data, width, mode=numpy_mode)
    else:
        value = {"constant": lambda: fill, "mean": lambda: v.data.mean(), "median": lambda: np.median(v.data), "minimum": lambda: v.data.min()}[mode]()
        v.data = np.pad(v.data, width, constant_values=value)
    v.move_origin([-a for a in by[::2]])


def crop(s: Subject, p: dict) -> None:
    for _, v in s.each():
        cropped(v, six(p["cropping"]))


def pad(s: Subject, p: dict) -> None:
    for _, v in s.each():
        padded(v, six(p["padding"]), p["padding_mode"], p["fill"])


def un_crop(s: Subject, p: dict) -> None:
    for _, v in s.each():
        padded(v, six(p["cropping"]), "constant", 0)


def un_pad(s: Subject, p: dict) -> None:
    for _, v in s.each():
        cropped(v, six(p["padding"]))


def to_shape(s: Subject, n: str, v: Volume, target: tuple, p: dict) -> None:
    """Pads, then crops to a shape, and notes both sides of each."""
    pads, crops = (list(x) for x in split_difference(v.shape, target))
    pads = pads if not p.get("only_crop") else [0] * 6
    crops = crops if not p.get("only_pad") else [0] * 6
    if p.get("location") == "random":
        u = draws(p).uniform("location", 3)
        for d in range(3):
            total = crops[2 * d] + crops[2 * d + 1]
            crops[2 * d] = int(u[d] * (total + 1))
            crops[2 * d + 1] = total - crops[2 * d]
    if any(pads):
        padded(v, tuple(pads), p["padding_mode"], p["fill"])
    if any(crops):
        cropped(v, tuple(crops))
    s.notes.setdefault("moved", {})[n] = [pads, crops]


def crop_or_pad(s: Subject, p: dict) -> None:
    want = p["target_shape"] if isinstance(p["target_shape"], tuple | list) else (p["target_shape"],) * 3
    factor = {"voxels": None, "mm": 1.0, "cm": 10.0}[p["units"]]
    for n, v in s.each():
        to_shape(s, n, v, tuple(None if t is None else round(t) if factor is None else round(t * factor / sp) for t, sp in zip(want, v.spacing, strict=True)), p)


def ensure_multiple(s: Subject, p: dict) -> None:
    for n, v in s.each():
        to_shape(s, n, v, multiple_shape(v.shape, p["target_multiple"], p["method"]), p)


def un_shape(s: Subject, p: dict) -> None:
    for n, v in s.each():
        pads, crops = p["moved"][n]
        padded(v, tuple(crops), "constant", 0)
        cropped(v, tuple(pads))


def orientation(affine: np.ndarray) -> str:
    """The codes of the axes; an axis takes the direction that it is nearest to of those still free."""
    left = np.linalg.svd(affine[:3, :3] / np.sqrt((affine[:3, :3] ** 2).sum(axis=0)))
    near = left[0] @ left[2]
    out = ""
    for c in range(3):
        r = int(np.abs(near[:, c]).argmax())
        out += "RAS"[r] if near[r, c] >= 0 else "LPI"[r]
        near[r] = 0
    return out


def flip_axes(spec, affine: np.ndarray) -> list[int]:
    """Axes by number or by the first letter of an anatomical word."""
    found = set()
    for a in [spec] if isinstance(spec, int | str) else spec:
        if isinstance(a, str):
            if a[:1].upper() not in LETTERS:
                raise ValueError(f"unknown direction {a!r}")
            a = [LETTERS[x] for x in orientation(affine)].index(LETTERS[a[0].upper()])
        if a not in (0, 1, 2):
            raise ValueError(f"an axis is 0, 1 or 2, not {a}")
        found.add(a)
    return sorted(found)


def flip(s: Subject, p: dict) -> None:
    for n, v in s.each():
        axes = flip_axes(p["axes"], v.affine)
        if p["flip_probability"] < 1:
            u = draws(p).uniform("flip", 3)
            axes = [a for a in axes if u[a] < p["flip_probability"]]
        v.data = np.flip(v.data, [a + 1 for a in axes])
        s.notes.setdefault("flipped", {})[n] = axes


def un_flip(s: Subject, p: dict) -> None:
    for n, v in s.each():
        v.data = np.flip(v.data, [a + 1 for a in p["flipped"][n]])


def turned(v: Volume, order, flips=()) -> None:
    """New axis d is the old axis order[d]; old axes in flips are reversed, and the affine follows."""
    for d in flips:
        v.move_origin([v.shape[d] - 1 if e == d else 0 for e in range(3)])
        v.affine[:3, d] *= -1
        v.data = np.flip(v.data, d + 1)
    v.data = v.data.transpose(0, *(d + 1 for d in order))
    v.affine = v.affine[:, [*order, 3]]


def transpose(s: Subject, p: dict) -> None:
    for _, v in s.each():
        turned(v, (2, 1, 0))


def turn_to(v: Volume, codes: str) -> None:
    order, signs = axis_mapping(orientation(v.affine), codes)
    turned(v, order, [d for d, sign in zip(order, signs, strict=True) if sign < 0])


def reorient(s: Subject, p: dict) -> None:
    for n, v in s.each():
        s.notes.setdefault("codes", {})[n] = orientation(v.affine)
        turn_to(v, p["orientation"])


def un_reorient(s: Subject, p: dict) -> None:
    for n, v in s.each():
        turn_to(v, p["codes"][n])


def copy_affine(s: Subject, p: dict) -> None:
    target = s.need(p["target"]).affine
    for _, v in s.each():
        v.affine = target.copy()


def to_reference(s: Subject, p: dict) -> None:
    ref = s.need(p["reference"])
    for _, v in s.each():
        m = np.eye(4)
        m[:3, :3] = ref.affine[:3, :3] * (np.array(ref.shape) / v.shape)
        center = ref.affine[:3, :3] @ ((np.array(ref.shape) - 1) / 2) + ref.affine[:3, 3]
        m[:3, 3] = center - m[:3, :3] @ ((np.array(v.shape) - 1) / 2)
        v.affine = m


# --- spatial: sampling ---
def nearest_axis(x: np.ndarray, d: int, n: int) -> np.ndarray:
    return np.take(x, np.minimum(np.arange(n) * x.shape[d] // n, x.shape[d] - 1), axis=d)


def resize(s: Subject, p: dict) -> None:
    want = (p["target_shape"],) * 3 if isinstance(p["target_shape"], int) else p["target_shape"]
    for _, v in s.each():
        linear = (p["label_interpolation"] if v.label else p["image_interpolation"]) == "linear"
        v.affine = v.affine @ np.diag([*(np.array(v.shape) / want), 1])
        for d, n in enumerate(want, 1):
            v.data = (kn.linear_axis if linear else nearest_axis)(v.data, d, n)


def anisotropy(s: Subject, p: dict) -> None:
    d = int(p["axes"]) + 1
    for _, v in s.each():
        n = v.data.shape[d]
        low = nearest_axis(v.data, d, max(1, round(n / p["downsampling"])))
        v.data = nearest_axis(low, d, n) if v.label or p["image_interpolation"] == "nearest" else kn.linear_axis(low, d, n)


def faces(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.take(x, k, axis=d).ravel() for d in range(3) for k in (0, -1)])


def otsu(values: np.ndarray) -> float:
    """The sorted value at which the between-class variance is largest; the first of equals."""
    v = np.sort(values)
    n = len(v)
    if n < 2:
        return float(v[0]) if n else 0.0
    k, low = np.arange(1, n), np.cumsum(v)[:-1]
    gap = low / k - (v.sum() - low) / (n - k)
    return float(v[int((k / n * (1 - k / n) * gap**2).argmax())])


def fill_value(v: Volume, how, label: float):
    """Of labels the pad label; a number; or for every channel its minimum, the mean of its faces, or of their values below Otsu's threshold."""
    if v.label:
        return label
    if not isinstance(how, str):
        return float(how)
    out = []
    for x in v.data:
        edge = faces(x)
        low = edge[edge < otsu(edge)] if how == "otsu" else edge
        out.append(x.min() if how == "minimum" else (low if low.size else edge).mean())
    if how not in ("minimum", "mean", "otsu"):
        raise ValueError(f"unknown fill {how!r}")
    return np.array(out)


def target_grid(s: Subject, v: Volume, target) -> tuple[tuple, np.ndarray]:
    """Shape and affine of: an image of the subject, a (shape, affine) pair, or a spacing; None keeps the image's own."""
    if target is None:
        return v.shape, v.affine
    if isinstance(target, str):
        ref = s.need(target)
        return ref.shape, ref.affine
    if isinstance(target, dict):
        return tuple(target["shape"]), np.array(target["affine"], float).reshape(4, 4)
    return kn.spaced_grid(v.shape, v.affine, np.array([target] * 3 if np.ndim(target) == 0 else target, float))


def folds(control: np.ndarray, largest, shape, spacing) -> list[int]:
    """Axes on which the largest displacement exceeds half the spacing of the control points' cubic mesh."""
    mesh = np.array(shape) * spacing / (np.array(control.shape[:3]) - 3)
    return np.flatnonzero(np.array(largest) > mesh / 2).tolist()


def spatial(s: Subject, p: dict, back: bool = False) -> None:
    """Resampling, affine map and elastic deformation in one sampling."""
    control = None
    if p["max_displacement"] is not None and any(p["max_displacement"]):
        n = p["num_control_points"]
        control = kn.control_points((n,) * 3 if isinstance(n, int) else tuple(n), p["max_displacement"], p["locked_borders"], draws(p))
    for name, v in s.each():
        if back:
            shape, affine, matrix = (np.array(x) for x in p["grids"][name])
            shape, affine, matrix = tuple(shape.tolist()), affine.reshape(4, 4), np.linalg.inv(matrix.reshape(4, 4))
        else:
            shape, affine = target_grid(s, v, p["target"])
            scales = [p["scales"][0]] * 3 if p["isotropic"] else p["scales"]
            matrix = kn.affine_matrix(v.shape, v.affine, scales, p["degrees"], p["translation"], p["center"])
            s.notes.setdefault("grids", {})[name] = [list(v.shape), v.affine.ravel().tolist(), matrix.ravel().tolist()]
            if control is not None and (axes := folds(control, p["max_displacement"], v.shape, v.spacing)):
                warnings.warn(f"the deformation may fold on axes {axes}", RuntimeWarning, stacklevel=2)
            if control is None and shape == v.shape and np.allclose(affine, v.affine) and np.allclose(matrix, np.eye(4)):
                continue  # exactly as it was
        x = v.data
        factor = np.sqrt((affine[:3, :3] ** 2).sum(axis=0)) / v.spacing
        if p["antialias"] and not v.label and not back:
            x = kn.blur(x, np.sqrt(np.maximum(factor**2 - 1, 0)) / (2 * math.sqrt(2 * math.log(2))))
        how = p["label_interpolation"] if v.label else p["image_interpolation"]
        first = p["affine_first"] != back
        fill = fill_value(v, p["default_pad_value"], p["default_pad_label"])
        by_share = v.label and how == "one_hot"
        v.data = kn.warp(x, v.affine, matrix, shape, affine, -control if back and control is not None else control, 1 if by_share else kn.order_of(how), fill, first, by_share)
        v.affine = affine


def un_spatial(s: Subject, p: dict) -> None:
    spatial(s, p, back=True)


def cast(s: Subject, p: dict) -> None:
    for _, v in s.each():
        v.data = v.data.astype(p["dtype"])


def take(s: Subject, p: dict) -> None:
    """Slices images; with ``spatial`` the index has no channels and all images must have one shape."""
    index = parse_index(p["index"]) if isinstance(p["index"], str) else p["index"]
    if p["spatial"]:
        if len({v.shape for _, v in s.each()}) > 1:
            raise RuntimeError("images of several shapes cannot be sliced as one subject")
        index = (slice(None), *normalize_index(index, 3))
    index = normalize_index(index)
    for _, v in s.each():
        v.affine = index_affine(v.affine, index[1:], v.shape)
        v.data = v.data[index]
        if not v.data.size:
            raise ValueError("nothing is left of the image")


def apply_function(s: Subject, p: dict) -> None:
    f: Callable = p["function"]
    for n, v in s.each():
        if p["types_to_apply"] in (None, "label" if v.label else "scalar"):
            out = np.asarray(f(v.data))
            if out.ndim != 4:
                raise ValueError(f"the function must return four dimensions for {n!r}")
            v.data = out


def apply_foreign(s: Subject, p: dict) -> None:
    """A transform that knows only arrays: one of all chosen images by name at once, or (``together`` false) one image at a time."""
    if not p["together"]:
        for _, v in s.each():
            v.data = np.asarray(p["function"](v.data))
        return
    found = p["function"]({n: v.data for n, v in s.each()})
    for n, x in found.items():
        if n not in s.images:
            raise KeyError(f"the function returned an image {n!r} that the subject does not have")
        s.images[n].data = np.asarray(x)
