"""Transforms as plan nodes: DataFrame in, DataFrame out, with provenance, composition and inversion.

A pipeline is lazily planned in two parts. Catalyst draws: for every row the steps that it gets, in its own order, and their drawn parameters
(gates, choices, ranges) are an array column, a function of the seed, the node's place and the row's key. One Arrow kernel then runs a row's
steps one after another on NumPy views of its images (``operators.volume``), so a pipeline of any length crosses to Python once and shuffles nothing.
The column ``history`` collects what was applied to every row, with its parameters as JSON; inversion replays it backwards.

New transforms join the registry by ``register``.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import rng
from ..functions.image import image_columns
from ..operators import kernels, volume as vo
from ..operators.intensity import QUANTILES
from ..operators.spatial import PAD_MODES
from .parameters import draw, draw3, non_negative

HISTORY = "array<struct<name:string,params:string>>"
PROGRAM = "array<struct<step:int,drawn:string>>"


@dataclass(frozen=True)
class Rule:
    """What a transform does: kind of image, parameters with defaults, forward and (if any) undo on a subject.

    one and three: parameters drawn as one number or one for each axis; counted: it draws numbers of its own from the row's key.
    """

    kind: str | None
    defaults: dict
    forward: Callable
    undo: Callable | None = None
    one: tuple[str, ...] = ()
    three: tuple[str, ...] = ()
    not_below_0: tuple[str, ...] = ()
    counted: bool = False
    identity: Callable = lambda p: False
    adds: Callable = lambda p: {}
    check: Callable = lambda p: None


def _require(ok: bool, text: str) -> None:
    if not ok:
        raise ValueError(text)


def _zero(*names: str) -> Callable:
    return lambda p: all(p[n] == 0 or p[n] == (0, 0, 0) for n in names)


_SHAPING = {"padding_mode": "constant", "fill": 0}
_SAMPLING = {"image_interpolation": "linear", "label_interpolation": "nearest", "default_pad_value": 0.0, "default_pad_label": 0}
_SPATIAL = {
    "target": None, "antialias": False, "scales": 1.0, "degrees": 0.0, "translation": 0.0, "isotropic": False, "center": "image",
    "num_control_points": 7, "max_displacement": None, "locked_borders": 2, "affine_first": True, **_SAMPLING,
}


def _spatial(**own) -> Rule:
    def check(p):
        kernels.order_of(p["image_interpolation"])
        _require(p["label_interpolation"] == "one_hot" or kernels.order_of(p["label_interpolation"]) < 2, "labels are taken nearest, linear or by one_hot shares")
        _require(p["center"] in ("image", "origin"), "center is image or origin")
        n = p["num_control_points"]
        _require(min(n if isinstance(n, tuple | list) else [n]) >= 4, "at least 4 control points an axis are needed")

    three = ("scales", "degrees", "translation", "max_displacement")
    return Rule(None, {**_SPATIAL, **own}, vo.spatial, vo.un_spatial, (), three, ("max_displacement",), True, check=check)


def _mode(p: dict) -> None:
    _require(p["padding_mode"] in PAD_MODES, f"unknown padding mode {p['padding_mode']!r}")


def _clamp_check(p: dict) -> None:
    _require(p["out_min"] is None or p["out_max"] is None or p["out_min"] <= p["out_max"], "out_min is above out_max")


REGISTRY: dict[str, Rule] = {
    "Clamp": Rule("scalar", {"out_min": None, "out_max": None}, vo.clamp, check=_clamp_check),
    "Gamma": Rule("scalar", {"log_gamma": 0.0}, vo.gamma, lambda s, p: vo.gamma(s, {"log_gamma": -p["log_gamma"]}), ("log_gamma",), identity=_zero("log_gamma")),
    "Normalize": Rule("scalar", {"out_min": -1.0, "out_max": 1.0, "in_min": None, "in_max": None, "percentile_low": 0.0, "percentile_high": 100.0, "mask": None}, vo.normalize, vo.un_normalize, ("out_min", "out_max")),
    "Standardize": Rule("scalar", {"mask": None}, vo.standardize, vo.un_standardize),
    "Mask": Rule("scalar", {"mask": "brain", "labels": None, "outside": 0.0}, vo.mask),
    "Noise": Rule("scalar", {"mean": 0.0, "std": 0.25, "rician": False}, vo.noise, None, ("mean", "std"), (), ("std",), True),
    "BiasField": Rule("scalar", {"std": 0.5, "scale": 0.025}, vo.bias, lambda s, p: vo.bias(s, p, -1), ("std",), (), ("std",), True, check=lambda p: _require(0 < p["scale"] <= 1, "scale must lie in (0, 1]")),
    "Blur": Rule("scalar", {"std": 0.0}, vo.blur, None, (), ("std",), ("std",), identity=_zero("std")),
    "HistogramStandardization": Rule("scalar", {"landmarks": [], "quantiles": None}, vo.histogram, check=lambda p: _require(len(p["landmarks"]) == len(p["quantiles"] or QUANTILES), "as many landmarks as quantiles are needed")),
    "Ghosting": Rule("scalar", {"num_ghosts": 4, "axes": (0, 1, 2), "intensity": 0.0, "restore": None}, vo.ghosting, None, ("num_ghosts", "axes", "intensity"), (), ("num_ghosts",), identity=_zero("intensity")),
    "Spike": Rule("scalar", {"num_spikes": 1, "intensity": 0.0}, vo.spike, None, ("num_spikes", "intensity"), (), ("num_spikes",), True, identity=_zero("intensity")),
    "Motion": Rule("scalar", {"degrees": 10.0, "translation": 10.0, "num_transforms": 2}, vo.motion, None, ("num_transforms",), (), ("num_transforms",), True),
    "Swap": Rule("scalar", {"patch_size": 15, "num_iterations": 100}, vo.swap, None, ("num_iterations",), (), ("num_iterations",), True),
    "PCA": Rule("scalar", {"num_components": 3, "whiten": True, "normalize": True, "values_range": (-2.3, 2.3), "clip": True}, vo.pca),
    "LabelsToImage": Rule(None, {"label_key": None, "image_key": "image_from_labels", "mean": None, "std": None, "default_mean": (0.1, 0.9), "default_std": (0.01, 0.1), "ignore_background": False}, vo.labels_to_image, counted=True, adds=lambda p: {p["image_key"]: T.DoubleType()}),
    "RemapLabels": Rule("label", {"remapping": {}}, vo.remap, vo.un_remap),
    "RemoveLabels": Rule("label", {"labels": [], "background": 0}, vo.remove),
    "SequentialLabels": Rule("label", {}, vo.sequential, vo.un_sequential),
    "OneHot": Rule("label", {"num_classes": -1}, vo.one_hot, vo.un_one_hot),
    "Contour": Rule("label", {}, vo.contour),
    "KeepLargestComponent": Rule("label", {"labels": None, "background": 0, "fully_connected": True}, vo.keep_largest),
    "Crop": Rule(None, {"cropping": 0}, vo.crop, vo.un_crop),
    "Pad": Rule(None, {"padding": 0, **_SHAPING}, vo.pad, vo.un_pad, check=_mode),
    "CropOrPad": Rule(None, {"target_shape": (None, None, None), "units": "voxels", "only_crop": False, "only_pad": False, "location": "center", **_SHAPING}, vo.crop_or_pad, vo.un_shape, counted=True, check=_mode),
    "EnsureShapeMultiple": Rule(None, {"target_multiple": 1, "method": "pad", **_SHAPING}, vo.ensure_multiple, vo.un_shape, check=_mode),
    "Flip": Rule(None, {"axes": 0, "flip_probability": 1.0}, vo.flip, vo.un_flip, counted=True),
    "Transpose": Rule(None, {}, vo.transpose, vo.transpose),
    "Reorient": Rule(None, {"orientation": "RAS"}, vo.reorient, vo.un_reorient),
    "CopyAffine": Rule(None, {"target": "t1"}, vo.copy_affine),
    "ToReferenceSpace": Rule(None, {"reference": "t1"}, vo.to_reference),
    "Resize": Rule(None, {"target_shape": 1, "image_interpolation": "linear", "label_interpolation": "nearest"}, vo.resize),
    "Anisotropy": Rule(None, {"axes": (0, 1, 2), "downsampling": 1.0, "image_interpolation": "linear"}, vo.anisotropy, None, ("axes", "downsampling"), identity=lambda p: p["downsampling"] == 1),
    "Resample": _spatial(target=1.0),
    "Affine": replace(_spatial(), identity=lambda p: p["scales"] == 1 and _zero("degrees", "translation")(p)),
    "ElasticDeformation": _spatial(max_displacement=7.5),
    "Spatial": _spatial(),
    "Slice": Rule(None, {"index": ":", "spatial": False}, vo.take),
    "To": Rule(None, {"dtype": "float64"}, vo.cast),
    "Lambda": Rule(None, {"function": None, "types_to_apply": None}, vo.apply_function, check=lambda p: _require(callable(p["function"]), "a function is needed")),
    "ArrayAdapter": Rule(None, {"function": None, "together": True}, vo.apply_foreign, check=lambda p: _require(callable(p["function"]), "a function is needed")),
}
# other names of the same transforms
REGISTRY |= {"RescaleIntensity": REGISTRY["Normalize"], "ZNormalization": REGISTRY["Standardize"]}


def register(name: str, rule: Rule) -> None:
    """Adds a transform of one's own; its functions must be importable or picklable."""
    if name in REGISTRY:
        raise ValueError(f"{name} is registered already")
    REGISTRY[name] = rule


class Node:
    """A part of a pipeline."""

    def __call__(self, df: DataFrame, *, key: str = "subject_id", seed: int = 0) -> DataFrame:
        steps: list[Transform] = []
        program = self.program(F.col(key), seed, "" if isinstance(self, Compose) else "/0", steps)
        return run_program(df, steps, program, key, seed)

    def inverse(self, df: DataFrame, *, ignore_intensity: bool = False) -> DataFrame:
        """Undoes every row's history, newest step first."""
        return invert_history(df, ignore_intensity=ignore_intensity)

    def __add__(self, other: Node) -> Compose:
        return Compose([*(self.parts if isinstance(self, Compose) else [self]), *(other.parts if isinstance(other, Compose) else [other])])

    def __or__(self, other: Node) -> OneOf:
        return OneOf([*(self.parts if isinstance(self, OneOf) and not self.weights else [self]), other])

    def to_json(self) -> str:
        return json.dumps([_spec(p) for p in (self.parts if isinstance(self, Compose) else [self])])


@dataclass
class Transform(Node):
    """One registered transform; p gates it by row, include and exclude choose images by name."""

    name: str
    params: dict = field(default_factory=dict)
    p: float = 1.0
    include: list[str] | None = None
    exclude: list[str] | None = None

    def __post_init__(self):
        if self.name not in REGISTRY:
            raise ValueError(f"unknown transform {self.name!r}")
        if not 0 <= self.p <= 1:
            raise ValueError("p lies in [0, 1]")
        rule = REGISTRY[self.name]
        unknown = set(self.params) - set(rule.defaults)
        if unknown:
            raise ValueError(f"{self.name} has no parameter {sorted(unknown)}")
        full = self.rule_params()
        rule.check(full)
        for name in rule.not_below_0:
            non_negative(full[name])
        for name in rule.three:
            if full[name] is not None:
                draw3(full[name], 0, "", F.lit(0))
        if rule.identity(full):
            warnings.warn(f"{self.name} does nothing with these parameters", stacklevel=3)

    def rule_params(self) -> dict:
        return {**REGISTRY[self.name].defaults, **self.params}

    def names(self, kinds: dict[str, str]) -> list[str]:
        wanted = REGISTRY[self.name].kind
        return [n for n, k in kinds.items() if wanted in (None, k) and (self.include is None or n in self.include) and n not in (self.exclude or ())]

    def program(self, key: Column, seed: int, stream: str, steps: list) -> Column:
        rule, params = REGISTRY[self.name], self.rule_params()
        drawn = {k: draw(_as_choice(k, params[k]), seed, f"{stream}.{k}", key) for k in rule.one if params[k] is not None}
        drawn |= {k: F.array(*draw3(params[k], seed, f"{stream}.{k}", key)) for k in rule.three if params[k] is not None}
        if isinstance(params.get("target"), tuple | list) and not _is_grid(params["target"]):
            drawn["target"] = F.array(*draw3(params["target"], seed, f"{stream}.target", key))
        text = F.to_json(F.struct(*(c.alias(k) for k, c in drawn.items()))) if drawn else F.lit("{}")
        steps.append((self, stream))
        one = F.array(F.struct(F.lit(len(steps) - 1).alias("step"), text.alias("drawn"))).cast(PROGRAM)
        return one if self.p == 1 else F.when(rng.uniform(seed, f"{stream}.p", key) < self.p, one).otherwise(F.array().cast(PROGRAM))

    def spec(self) -> dict:
        out = {"name": self.name, **{k: v for k, v in self.params.items()}}
        for k, default in (("p", 1.0), ("include", None), ("exclude", None)):
            if getattr(self, k) != default:
                out[f"_{k}"] = getattr(self, k)
        return out


def _as_choice(name: str, spec):
    """Of several axes one is drawn."""
    return {"choice": list(spec)} if name == "axes" and isinstance(spec, tuple | list) else spec


def _is_grid(target) -> bool:
    """A (shape, affine) pair."""
    return len(target) == 2 and np.ndim(target[0]) == 1


@dataclass
class Compose(Node):
    """A sequence; nodes may be transforms or other compositions."""

    parts: list

    def program(self, key, seed, stream, steps):
        made = [part.program(key, seed, f"{stream}/{n}", steps) for n, part in enumerate(self.parts)]
        return F.concat(*made) if made else F.array().cast(PROGRAM)


@dataclass
class OneOf(Node):
    """Every row gets one of the parts, by weight."""

    parts: list
    weights: list[float] | None = None

    def program(self, key, seed, stream, steps):
        pick = rng.choose(rng.uniform(seed, f"{stream}.one", key), list(range(len(self.parts))), self.weights)
        made = [part.program(key, seed, f"{stream}/{n}", steps) for n, part in enumerate(self.parts)]
        out = made[-1]
        for n in range(len(made) - 2, -1, -1):
            out = F.when(pick == n, made[n]).otherwise(out)
        return out


@dataclass
class SomeOf(Node):
    """Every row gets between least and most of the parts, in an order of its own (drawn from hashes); with replacement a part may come again."""

    parts: list
    least: int = 1
    most: int | None = None
    replacement: bool = False

    def program(self, key, seed, stream, steps):
        most = self.most or len(self.parts)
        if not 0 <= self.least <= most or (most > len(self.parts) and not self.replacement):
            raise ValueError("0 <= least <= most is needed, and most is the number of parts without replacement")
        count = (F.floor(rng.uniform(seed, f"{stream}.n", key) * (most - self.least + 1)) + self.least).cast("int")
        if self.replacement:
            slots = []
            for slot in range(most):
                made = OneOf(self.parts).program(key, seed, f"{stream}/{slot}", steps)
                slots.append(F.when(F.lit(slot) < count, made).otherwise(F.array().cast(PROGRAM)))
            return F.concat(*slots)
        made = F.array(*(part.program(key, seed, f"{stream}/{n}", steps) for n, part in enumerate(self.parts)))
        order = F.array_sort(F.array(*(F.struct(rng.uniform(seed, f"{stream}.o{n}", key).alias("u"), F.lit(n).alias("n")) for n in range(len(self.parts)))))
        return F.flatten(F.transform(F.slice(order, F.lit(1), count), lambda o: F.get(made, o["n"])))


def _spec(part) -> dict:
    if isinstance(part, Transform):
        return part.spec()
    out = {"name": type(part).__name__, "transforms": [_spec(p) for p in part.parts]}
    for k in ("weights", "least", "most", "replacement"):
        if getattr(part, k, None) not in (None, False):
            out[k] = getattr(part, k)
    return out


def from_json(text: str) -> Compose:
    """The pipeline of to_json."""

    def node(d: dict):
        d = dict(d)
        name = d.pop("name")
        if "transforms" in d:
            parts = [node(x) for x in d.pop("transforms")]
            return {"Compose": Compose, "OneOf": OneOf, "SomeOf": SomeOf}[name](parts, **d)
        own = {k[1:]: d.pop(k) for k in list(d) if k.startswith("_")}
        return Transform(name, d, **own)

    return Compose([node(d) for d in json.loads(text)])


# --- the kernel ---
def _subjects(batch: pa.RecordBatch, names: list[str], labels: dict[str, bool]) -> list[vo.Subject]:
    """The rows of a batch as subjects; voxels are views of the Arrow buffers."""
    out = [vo.Subject({}) for _ in range(batch.num_rows)]
    for n in names:
        col = batch.column(n)
        size = np.column_stack([col.field(k).to_numpy(zero_copy_only=False) for k in ("c", "si", "sj", "sk")])
        data, affine = col.field("data"), col.field("affine")
        values, at = data.values.to_numpy(zero_copy_only=False), data.offsets.to_numpy()
        numbers, place = affine.values.to_numpy(zero_copy_only=False), affine.offsets.to_numpy()
        for r in np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False)).tolist():
            x = values[at[r] : at[r + 1]].reshape(size[r].astype(int))
            x = x if labels[n] else x.astype(float, copy=False)
            out[r].images[n] = vo.Volume(x, numbers[place[r] : place[r + 1]].reshape(4, 4), labels[n])
    return out


def _column(subjects: list[vo.Subject], name: str, kind: T.DataType) -> pa.StructArray:
    """An image of all subjects as an Arrow column."""
    found = [s.images.get(name) for s in subjects]
    element = {"integer": pa.int32(), "double": pa.float64(), "float": pa.float32(), "long": pa.int64(), "short": pa.int16(), "byte": pa.int8()}[kind.typeName()]
    flat = [np.zeros(0) if v is None else v.data.ravel() for v in found]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
    values = np.concatenate(flat).astype(element.to_pandas_dtype(), copy=False) if flat else np.zeros(0)
    shape = np.array([[1, 0, 0, 0] if v is None else v.data.shape for v in found], dtype=np.int32).reshape(-1, 4)
    affine = np.concatenate([np.zeros(16) if v is None else v.affine.ravel() for v in found]) if found else np.zeros(0)
    parts = [*(pa.array(shape[:, k]) for k in range(4)), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * 16), pa.array(affine)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, element))]
    return pa.StructArray.from_arrays(parts, names=["c", "si", "sj", "sk", "affine", "data"], mask=pa.array([v is None for v in found]))


_RECORD = pa.list_(pa.struct([("name", pa.string()), ("params", pa.string())]))


def _with_images(schema: T.StructType, new: dict[str, T.DataType]) -> T.StructType:
    shape = [T.StructField(k, T.IntegerType()) for k in ("c", "si", "sj", "sk")]
    for n, element in new.items():
        image = T.StructType([*shape, T.StructField("affine", T.ArrayType(T.DoubleType())), T.StructField("data", T.ArrayType(element))])
        schema = T.StructType([f for f in schema.fields if f.name != n] + [T.StructField(n, image)])
    return schema


def _kernel(df: DataFrame, extra: list[str], new: dict[str, T.DataType], work: Callable) -> DataFrame:
    """work(subject, history, *extra columns) -> history, over all rows of df; extra columns are dropped."""
    scalars = image_columns(df, "scalar")
    elements = {n: df.schema[n].dataType["data"].dataType.elementType for n in image_columns(df)}
    labels = {n: n not in scalars for n in elements}
    kept = [f for f in df.schema.fields if f.name not in (*extra, "history")]
    out = _with_images(T.StructType(kept), new)
    elements |= new
    order = [f.name for f in out.fields]
    schema = T.StructType([*out.fields, T.StructField("history", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("params", T.StringType())])))])
    had = "history" in df.columns

    def run(batches):
        for batch in batches:
            rows = _subjects(batch, list(labels), labels)
            old = batch.column("history").to_pylist() if had else [[] for _ in rows]
            given = zip(*(batch.column(c).to_pylist() for c in extra), strict=True) if extra else [()] * len(rows)
            history = [work(s, h or [], *g) for s, h, g in zip(rows, old, given, strict=True)]
            columns = [_column(rows, n, elements[n]) if n in elements else batch.column(n) for n in order]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(history, _RECORD)], names=[*order, "history"])

    return df.mapInArrow(run, schema)


def run_program(df: DataFrame, steps: list, program: Column, key: str, seed: int) -> DataFrame:
    """Runs every row's steps on its images; one pass, no shuffle."""
    scalars = image_columns(df, "scalar")
    kinds = {n: "scalar" if n in scalars else "label" for n in image_columns(df)}
    plan, new = [], {}
    for t, stream in steps:
        rule = REGISTRY[t.name]
        plan.append((t.name, rule, t.rule_params(), t.names(kinds), stream))
        new |= rule.adds(t.rule_params())
        kinds |= dict.fromkeys(rule.adds(t.rule_params()), "scalar")
    new = {n: e for n, e in new.items() if n not in df.columns}

    def work(s: vo.Subject, history: list, todo: list, name) -> list:
        out = list(history)
        for item in todo:
            title, rule, params, chosen, stream = plan[item["step"]]
            p = {**params, **json.loads(item["drawn"])}
            if rule.counted:
                p["draw"] = [f"{seed}|{stream}", str(name)]
            s.chosen, s.notes = chosen, {}
            rule.forward(s, p)
            out.append({"name": title, "params": json.dumps({**p, **s.notes, "images": chosen}, sort_keys=True, default=str)})
        return out

    own = ["_program", "_key"]
    while any(n in df.columns for n in own):
        own = [f"_{n}" for n in own]
    rows = df.withColumns({own[0]: program, own[1]: F.col(key).cast("string")})
    return _kernel(rows, own, new, work)


def invert_history(df: DataFrame, *, steps: int | None = None, ignore_intensity: bool = False) -> DataFrame:
    """Undoes what ``history`` says of every row, newest first; rows may differ in their histories.

    A record of an unknown transform, of one that has no inverse, or (with ignore_intensity) of one of intensities stays in the history.
    """
    rules = dict(REGISTRY)

    def work(s: vo.Subject, history: list) -> list:
        left = []
        for back, record in enumerate(reversed(history)):
            rule = rules.get(record["name"])
            if rule is None or rule.undo is None or (ignore_intensity and rule.kind == "scalar") or (steps is not None and back >= steps):
                left.append(record)
                continue
            p = json.loads(record["params"])
            s.chosen, s.notes = p["images"], {}
            rule.undo(s, p)
        return left[::-1]

    return _kernel(df, [], {}, work)
