"""The registry: every transform on NumPy subjects, its undoing from the record, and the plans that draw and run them."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import affine as A, rng
from voxlake.functions.image import image
from voxlake.operators import kernels as kn, volume as vo
from voxlake.plans import compose
from voxlake.plans.compose import REGISTRY, Compose, OneOf, Rule, SomeOf, Transform, invert_history
from voxlake.sources.generators import zone_plate

SPACING = (1.0, 2.0, 3.0)


def subject(seed: int = 0, shape=(2, 6, 7, 8)) -> vo.Subject:
    r = np.random.default_rng(seed)
    a = np.diag([*SPACING, 1.0])
    a[:3, 3] = (10, 20, 30)
    seg = (r.random((1, *shape[1:])) * 3).astype(np.int32)
    return vo.Subject({"t1": vo.Volume(r.normal(5, 2, shape), a.copy(), False), "seg": vo.Volume(seg, a.copy(), True), "brain": vo.Volume((seg > 0).astype(np.int32), a.copy(), True)})


def apply(s: vo.Subject, name: str, **params) -> dict:
    """Runs a registered transform on all images of its kind; the record as it is read back."""
    rule = REGISTRY[name]
    p = {**rule.defaults, **params}
    for k in rule.three:
        if p[k] is not None and np.ndim(p[k]) == 0:
            p[k] = [p[k]] * 3
    if name in ("Ghosting", "Anisotropy") and not isinstance(p["axes"], int):
        p["axes"] = 1
    p["draw"] = ["3|/0", "key"]
    s.chosen, s.notes = [n for n, v in s.images.items() if rule.kind in (None, "label" if v.label else "scalar")], {}
    rule.forward(s, p)
    return json.loads(json.dumps({**p, **s.notes, "images": s.chosen}, default=str))


def undo(s: vo.Subject, name: str, record: dict) -> None:
    s.chosen = record["images"]
    REGISTRY[name].undo(s, record)


PARAMS = {
    "Clamp": {"out_min": 4.0}, "Gamma": {"log_gamma": 0.2}, "HistogramStandardization": {"landmarks": list(range(13))}, "Blur": {"std": 1.0}, "Ghosting": {"intensity": 0.7}, "Spike": {"intensity": 0.2},
    "Swap": {"patch_size": 2, "num_iterations": 4}, "PCA": {"num_components": 2}, "RemapLabels": {"remapping": {1: 7}}, "RemoveLabels": {"labels": [1]}, "Crop": {"cropping": 1}, "Pad": {"padding": (1, 2, 0)},
    "CropOrPad": {"target_shape": (4, 9, None)}, "EnsureShapeMultiple": {"target_multiple": 4}, "Flip": {"axes": (0, 2)}, "Reorient": {"orientation": "PIL"}, "Resize": {"target_shape": (3, 7, 9)},
    "Anisotropy": {"downsampling": 2.0}, "Affine": {"degrees": 10.0, "scales": 1.1}, "ElasticDeformation": {"max_displacement": 0.5}, "Lambda": {"function": lambda x: x + 1}, "Motion": {"num_transforms": 2, "degrees": 2.0, "translation": 0.3},
    "Noise": {"rician": True}, "BiasField": {"scale": 0.5}, "ArrayAdapter": {"function": lambda d: {n: x + 1 for n, x in d.items()}},
}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_every_transform_runs_and_repeats(name):
    one, two = subject(), subject()
    record = apply(one, name, **PARAMS.get(name, {}))
    apply(two, name, **PARAMS.get(name, {}))
    assert record["images"] and all(np.array_equal(one.images[n].data, two.images[n].data) for n in one.images)
    assert all(v.data.ndim == 4 and np.isfinite(v.data).all() for v in one.images.values())


EXACT = ["Gamma", "Normalize", "Standardize", "BiasField", "RemapLabels", "SequentialLabels", "OneHot", "Pad", "EnsureShapeMultiple", "Flip", "Transpose", "Reorient"]


@pytest.mark.parametrize("name", EXACT)
def test_undo_restores(name):
    s, want = subject(), subject()
    undo(s, name, apply(s, name, **PARAMS.get(name, {})))
    for n, v in want.images.items():
        assert np.allclose(s.images[n].data, v.data, atol=1e-9) and np.allclose(s.images[n].affine, v.affine), (name, n)


def test_undo_of_lossy_transforms():
    s, want = subject(), subject()
    undo(s, "Crop", apply(s, "Crop", cropping=1))
    inner = (slice(None), *[slice(1, -1)] * 3)
    assert np.array_equal(s.images["t1"].data[inner], want.images["t1"].data[inner]) and np.allclose(s.images["t1"].affine, want.images["t1"].affine)
    s = subject()
    undo(s, "CropOrPad", apply(s, "CropOrPad", target_shape=(4, 9, None)))
    assert s.images["t1"].shape == want.images["t1"].shape and np.allclose(s.images["t1"].affine, want.images["t1"].affine)
    for name, params in (("Affine", {"translation": (1.0, -2.0, 3.0)}), ("Resample", {"target": [2.0, 2.0, 3.0]}), ("ElasticDeformation", {"max_displacement": 0.3})):
        s = subject()
        undo(s, name, apply(s, name, **params))
        assert s.images["t1"].shape == want.images["t1"].shape and np.allclose(s.images["t1"].affine, want.images["t1"].affine)
    s = subject()
    undo(s, "Affine", apply(s, "Affine", translation=(1.0, -2.0, 3.0)))  # whole voxels
    inner = (slice(None), *[slice(2, -2)] * 3)
    assert np.allclose(s.images["t1"].data[inner], want.images["t1"].data[inner])


def test_spike_and_ghosting_by_the_whole_spectrum():
    x = subject().images["t1"].data
    axes = (1, 2, 3)
    f = np.fft.fftshift(np.fft.fftn(x, axes=axes), axes=axes)
    g = f.copy()
    for p in [(0.9, 0.2, 0.6), (0.1, 0.5, 0.99)]:
        g[(slice(None), *(int(q * n) % n for q, n in zip(p, x.shape[1:], strict=True)))] += 0.3 * np.abs(f).max(axis=axes)
    assert np.allclose(kn.spike(x, [(0.9, 0.2, 0.6), (0.1, 0.5, 0.99)], 0.3), np.fft.ifftn(np.fft.ifftshift(g, axes=axes), axes=axes).real)
    for num, axis, restore in ((2, 0, None), (3, 1, 0.3), (9, 2, 0.02)):
        n = x.shape[axis + 1]
        w = np.ones(n)
        w[:: max(n // num, 1)] = 0.4
        if restore:
            half = max(int(n * restore / 2), 1)
            w[n // 2 - half : n // 2 + half] = 1
        want = np.fft.ifftn(np.fft.ifftshift(f * w.reshape([-1 if d == axis + 1 else 1 for d in range(4)]), axes=axes), axes=axes).real
        assert np.allclose(kn.ghosting(x, num, axis, 0.6, restore), want)


def test_fixed_values(spark):
    ring = zone_plate(spark, 21).where("i = 13 and j = 10 and k = 10").head()["v"]
    assert math.isclose(ring, math.sin(0.8 * math.pi * 9 / -20) * (0.5 * math.tanh(13) + 0.5)) and abs(ring + 0.905) < 1e-3
    even = zone_plate(spark, 4).where("i = 3 and j = 1 and k = 1").head()["v"]  # from -1 to 2
    assert math.isclose(even, math.sin(0.8 * math.pi * 4 / -2) * (0.5 * math.tanh((-1 - 2) / -0.1) + 0.5))
    field = kn.bias_field((2, 9, 9, 9), 0.5, 0.1, rng.Draws(1, 2))
    assert field.shape == (2, 9, 9, 9) and not np.allclose(field[0], field[1]) and np.allclose(np.log(field[0, 0, 0, 0]), 0.5 * rng.Draws(1, 2).normal("bias", 1)[0])
    x = np.random.default_rng(1).normal(size=(3, 5, 5, 1))
    plain = kn.pca(x, 2, whiten=False, normalize=False, values=(-1, 3), clip=False) * 4 - 1
    scaled = kn.pca(x, 2, whiten=False, normalize=True, values=(-1, 3), clip=False) * 4 - 1
    assert np.allclose(scaled * plain[0].std(ddof=1), plain)
    pairs = kn.swap_pairs((3, 3, 3), (2, 2, 2), 50, rng.Draws(0, 0))
    assert len(pairs) == 50  # patches that leave no room for another are kept too
    values = np.array([1.0, 1.2, 0.9, 7.0, 7.5, 8.0, 1.1])
    assert vo.otsu(values) == 7.0 or vo.otsu(values) == 1.2


def test_counter_numbers_agree(spark):
    got = spark.range(64).select("id", rng.voxel_uniform(rng.base(7, "s", F.lit("k")), F.col("id")).alias("u"), rng.voxel_normal(rng.base(7, "s.u", F.lit("k")), rng.base(7, "s.v", F.lit("k")), F.col("id")).alias("z")).orderBy("id").toPandas()
    assert np.allclose(got.u, rng.Draws(7, "k").uniform("s", 64), rtol=0, atol=1e-15) and np.allclose(got.z, rng.Draws(7, "k").normal("s", 64))
    z = rng.Draws(1, 1).normal("z", 200_000)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs(np.corrcoef(z[1:], z[:-1])[0, 1]) < 0.01


def test_geometry_of_spatial_transforms():
    s = subject()
    v = s.images["t1"]
    center = v.affine[:3, :3] @ ((np.array(v.shape) - 1) / 2) + v.affine[:3, 3]
    apply(s, "Resample", target=[2.0, 2.0, 2.0])
    v = s.images["t1"]
    assert v.shape == (3, 7, 12) and np.allclose(v.spacing, 2) and np.allclose(v.affine[:3, :3] @ ((np.array(v.shape) - 1) / 2) + v.affine[:3, 3], center)
    s, ref = subject(), subject(1, (1, 4, 4, 4))
    s.images["ref"] = ref.images["t1"]
    apply(s, "Resample", target="ref")
    assert s.images["t1"].shape == (4, 4, 4)
    s = subject()
    apply(s, "Resample", target={"shape": [3, 3, 3], "affine": np.eye(4).ravel().tolist()})
    assert s.images["seg"].shape == (3, 3, 3) and np.allclose(s.images["seg"].affine, np.eye(4))
    flat = vo.Subject({"t1": vo.Volume(np.random.default_rng(0).random((1, 5, 5, 1)), np.eye(4), False)})
    want = flat.images["t1"].data.copy()
    apply(flat, "Affine", degrees=[40.0, 40.0, 0.0], translation=[0.0, 0.0, 9.0])
    assert np.array_equal(flat.images["t1"].data, want)  # one slice stays in its plane
    s = subject()
    apply(s, "Affine", translation=[100.0, 0.0, 0.0], default_pad_value="minimum", default_pad_label=9)
    assert np.allclose(s.images["t1"].data[0], subject().images["t1"].data[0].min()) and (s.images["seg"].data == 9).all()
    s = subject()
    apply(s, "Affine", translation=[100.0, 0.0, 0.0], default_pad_value="mean")
    assert np.allclose(s.images["t1"].data[1], vo.faces(subject().images["t1"].data[1]).mean())
    with pytest.warns(RuntimeWarning, match="fold"):
        apply(subject(), "ElasticDeformation", max_displacement=20.0)
    s = subject()
    apply(s, "CropOrPad", target_shape=(1.2, None, 1.2), units="cm")
    assert s.images["t1"].shape == (12, 7, 4)
    s = subject()
    apply(s, "CropOrPad", target_shape=(4, 9, 8), only_pad=True, location="random")
    assert s.images["t1"].shape == (6, 9, 8)
    assert vo.orientation(np.array([[0, -2, 0, 5], [1.5, 0, 0, -1], [0, 0, 3, 2], [0, 0, 0, 1.0]])) == "ALS"
    assert vo.flip_axes(["Left", "I"], np.diag([1.0, 1, 1, 1])) == [0, 2] and vo.flip_axes("AP", np.array([[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])) == [0]
    with pytest.raises(ValueError):
        vo.flip_axes("Q", np.eye(4))


def test_masks_and_errors():
    s = subject()
    want = s.images["t1"].data.copy()
    apply(s, "Standardize", mask=lambda x: x > 5)
    inside = want[want > 5]
    assert np.allclose(s.images["t1"].data, (want - inside.mean()) / inside.std(ddof=1))
    s = subject()
    apply(s, "Mask", mask="seg", labels=[2], outside=-1.0)
    assert np.allclose(s.images["t1"].data, np.where(s.images["seg"].data == 2, want, -1))
    same = vo.Subject({"t1": vo.Volume(np.ones((1, 2, 2, 2)), np.eye(4), False)})
    with pytest.raises(RuntimeError):
        apply(same, "Standardize")
    with pytest.warns(UserWarning):
        assert "ranges" not in apply(same, "Normalize")
    with pytest.raises(KeyError):
        apply(subject(), "CopyAffine", target="nothing")
    with pytest.raises(ValueError):
        apply(subject(), "Crop", cropping=4)
    for name, bad in (("Noise", {"std": -1.0}), ("BiasField", {"scale": 0.0}), ("Clamp", {"out_min": 2, "out_max": 1}), ("Pad", {"padding_mode": "x"}), ("Affine", {"degrees": (1, 2, 3, 4)}), ("ElasticDeformation", {"num_control_points": 3}), ("Blur", {"std": (-1, 1)}), ("Lambda", {})):
        with pytest.raises(ValueError):
            Transform(name, bad)
    for name in ("Blur", "Gamma", "Ghosting", "Spike", "Affine", "Anisotropy"):
        with pytest.warns(UserWarning, match="nothing"):
            Transform(name)


@pytest.fixture(scope="module")
def df(spark):
    rows = []
    for i in range(6):
        s = subject(i, (1, 4, 4, 4))
        rows.append((i, s.images["t1"].data.ravel().tolist(), s.images["seg"].data.ravel().tolist(), "x"))
    d = spark.createDataFrame(rows, "subject_id long, d array<double>, m array<int>, _program string")
    a = A.from_spacing(list(SPACING), [10, 20, 30])
    return d.select("subject_id", image(1, 4, 4, 4, a, F.col("d")).alias("t1"), image(1, 4, 4, 4, a, F.col("m")).alias("seg")).cache()


def records(df):
    return {r["subject_id"]: [(h["name"], json.loads(h["params"])) for h in r["history"]] for r in df.select("subject_id", "history").collect()}


def test_parameter_forms(df):
    specs = [2.0, (1.0, 3.0), (1.0, 2.0, 3.0), (0.0, 1.0, 2.0, 3.0, 4.0, 5.0), ((0.0, 1.0), 2.0, {"choice": [7.0, 8.0]}), {"normal": [0.0, 1.0]}]
    for spec in specs:
        got = [p["degrees"] for ((_, p),) in records(Compose([Transform("Affine", {"degrees": spec})])(df, seed=3)).values()]
        got = np.array(got)
        assert got.shape == (6, 3)
        if spec == 2.0:
            assert (got == 2).all()
        elif spec == (1.0, 3.0):
            assert ((got > 1) & (got < 3)).all() and len(np.unique(got)) == 18
        elif spec == (1.0, 2.0, 3.0):
            assert (got == [1, 2, 3]).all()
        elif len(spec) == 6:
            assert ((got > [0, 2, 4]) & (got < [1, 3, 5])).all()
        elif isinstance(spec, tuple):
            assert (got[:, 1] == 2).all() and set(got[:, 2]) <= {7, 8}


def test_plans_ignore_partitions_and_keep_columns(df):
    steps = Compose([Transform("Noise", {"std": (0.1, 0.2)}, p=0.5), Transform("Swap", {"patch_size": 2, "num_iterations": 2}), Transform("LabelsToImage")])
    wide = df.withColumns({"age": F.lit(4), "_program": F.lit("own"), "_key": F.lit(1)})
    one, many = (sorted((r["subject_id"], r["age"], r["_program"], r["t1"]["data"], r["image_from_labels"]["data"], str(r["history"])) for r in steps(wide.repartition(n), seed=5).collect()) for n in (1, 5))
    assert one == many and len(one) == 6
    gated = records(steps(df, seed=5))
    assert {len(h) for h in gated.values()} == {2, 3}
    assert {len(h) for h in records(Compose([Transform("Transpose", p=0.0)])(df)).values()} == {0}


def test_null_images_and_empty_tables(spark, df):
    some = df.withColumn("t1", F.when(F.col("subject_id") != 2, F.col("t1")))
    out = Compose([Transform("Clamp", {"out_max": 1.0}), Transform("Transpose")])(some)
    rows = {r["subject_id"]: r for r in out.collect()}
    assert rows[2]["t1"] is None and rows[3]["t1"]["si"] == 4 and len(rows[2]["history"]) == 2
    assert Compose([Transform("Transpose")])(df.limit(0)).count() == 0 and Compose([])(df).count() == 6


def test_inverse_keeps_what_it_cannot_undo(df):
    steps = Compose([Transform("Flip", {"axes": 0}), Transform("Blur", {"std": 1.0}), OneOf([Transform("Transpose"), Transform("Gamma", {"log_gamma": 0.1})])])
    back = invert_history(steps(df, seed=1))
    assert {tuple(n for n, _ in h) for h in records(back).values()} == {("Blur",)}
    assert {"Gamma" in dict(h) for h in records(invert_history(steps(df, seed=1), ignore_intensity=True)).values()} == {False, True}
    assert {len(h) for h in records(invert_history(steps(df, seed=1), steps=1)).values()} == {2}


def test_own_transform_and_operators(df):
    def shift(s, p):
        for _, v in s.each():
            v.data = v.data + p["by"]

    def back(s, p):
        for _, v in s.each():
            v.data = v.data - p["by"]

    compose.register("Shift", Rule("scalar", {"by": 1.0}, shift, back, ("by",)))
    try:
        steps = Transform("Shift", {"by": (2.0, 3.0)}) + Transform("Transpose") + Compose([Transform("Flip")])
        assert isinstance(steps, Compose) and len(steps.parts) == 3
        got = {r["subject_id"]: r["t1"]["data"] for r in invert_history(steps(df, seed=2)).collect()}
        assert all(np.allclose(got[r["subject_id"]], r["t1"]["data"]) for r in df.collect())
        with pytest.raises(ValueError):
            compose.register("Shift", Rule("scalar", {}, shift))
    finally:
        REGISTRY.pop("Shift")
    either = Transform("Transpose") | Transform("Flip") | Transform("Contour")
    assert isinstance(either, OneOf) and len(either.parts) == 3 and {len(h) for h in records(either(df)).values()} == {1}
    some = SomeOf([Transform("Transpose"), Transform("Flip")], 3, 5, True)
    assert {len(h) for h in records(some(df)).values()} <= {3, 4, 5}
    assert compose.from_json(Compose([some]).to_json()).parts[0].replacement
    with pytest.raises(ValueError):
        SomeOf([Transform("Transpose")], 2, 3)(df)


@pytest.mark.parametrize("order", range(2, 8))
def test_splines(order):
    x = np.random.default_rng(order).normal(size=(2, 9, 8, 7))
    assert np.allclose(kn.sample(x, kn.grid(x.shape[1:]), order), x)  # through the values
    t = np.linspace(-4, 4, 4001)
    assert np.isclose(kn.bspline(t, order).sum() * (t[1] - t[0]), 1) and np.allclose(sum(kn.bspline(np.array([0.3]) - k, order) for k in range(-5, 6)), 1)
    assert np.allclose(kn.sample(np.full((1, 6, 6, 6), 3.0), np.random.default_rng(1).uniform(0, 5, (20, 3)), order), 3)
    n = 40
    curve = np.cos(2 * np.pi * (np.arange(n) + 0.5) / n).reshape(1, n, 1, 1)  # even about both ends, as the mirrored border is
    at = np.column_stack([np.linspace(0.2, n - 1.2, 50), np.zeros(50), np.zeros(50)])
    assert np.abs(kn.sample(curve, at, order)[0] - np.cos(2 * np.pi * (at[:, 0] + 0.5) / n)).max() < 2e-3
    assert kn.sample(x, np.array([[-0.2, 1.0, 1.0], [8.2, 1.0, 1.0]]), order).max() == 0
    s = subject()
    apply(s, "Affine", degrees=[5.0, 0.0, 0.0], image_interpolation=order)
    assert np.isfinite(s.images["t1"].data).all()
    with pytest.raises(ValueError):
        Transform("Affine", {"degrees": 3.0, "image_interpolation": "ninth"})
