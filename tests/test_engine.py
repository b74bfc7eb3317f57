"""Kernels against direct formulas, operators against NumPy, plans, sources and streaming."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import affine as A, rng
from voxlake.functions.image import image
from voxlake.operators import annotations as an, intensity as it, kernels as kn, label as lb, patches as pt, spatial as sp
from voxlake.plans.compose import Compose, OneOf, SomeOf, Transform, from_json
from voxlake.plans.parameters import draw3
from voxlake.sources import generators, nifti
from voxlake.streaming.queue import patch_queue

SHAPE = (1, 3, 4, 5)


@pytest.fixture(scope="module")
def volumes():
    r = np.random.default_rng(0)
    return {i: r.normal(0, 1, SHAPE) for i in range(3)}


@pytest.fixture(scope="module")
def df(spark, volumes):
    rows = [(i, v.ravel().tolist(), (v.ravel() > 0).astype(int).tolist()) for i, v in volumes.items()]
    d = spark.createDataFrame(rows, "subject_id long, d array<double>, m array<int>")
    a = A.from_spacing([1, 2, 3], [10, 20, 30])
    return d.select("subject_id", image(*SHAPE, a, F.col("d")).alias("t1"), image(*SHAPE, a, F.col("m")).alias("seg")).cache()


def run(df, img):
    out = {}
    for r in df.select("subject_id", img.alias("x")).collect():
        x = r["x"]
        out[r["subject_id"]] = (np.array(x["data"]).reshape(x["c"], x["si"], x["sj"], x["sk"]), np.array(x["affine"]).reshape(4, 4))
    return out


def close(got, volumes, f):
    for i, v in volumes.items():
        want = f(v)
        assert got[i][0].shape == want.shape and np.allclose(got[i][0], want, atol=1e-9)


def test_intensity(df, volumes):
    x, m = F.col("t1"), F.col("seg")
    close(run(df, it.clamp(x, -0.5, 0.5)), volumes, lambda v: v.clip(-0.5, 0.5))
    close(run(df, it.gamma(x, 0.2)), volumes, lambda v: np.sign(v) * np.abs(v) ** math.exp(0.2))
    close(run(df, it.standardize(x)), volumes, lambda v: (v - v.mean()) / v.std(ddof=1))
    close(run(df, it.standardize(x, m)), volumes, lambda v: (v - v[v > 0].mean()) / v[v > 0].std(ddof=1))

    def norm(v):
        lo, hi = np.percentile(v, [5, 95])
        return (v.clip(lo, hi) - lo) / (hi - lo) * 2 - 1

    close(run(df, it.normalize(x, percentiles=(5, 95))), volumes, norm)
    close(run(df, it.apply_mask(x, m, outside=9)), volumes, lambda v: np.where(v > 0, v, 9))
    marks = [100 * q for q in it.QUANTILES]
    got = run(df, it.histogram_standardize(x, marks))
    for i, v in volumes.items():
        p = np.quantile(v, it.QUANTILES)
        inner = (v >= p[0]) & (v <= p[-1])
        assert np.allclose(got[i][0][inner], np.interp(v[inner], p, marks))


def test_constant_image(spark):
    d = spark.createDataFrame([(0, [2.0] * 8)], "subject_id long, d array<double>").select("subject_id", image(1, 2, 2, 2, A.from_spacing([1, 1, 1], [0, 0, 0]), F.col("d")).alias("t1"))
    assert (run(d, it.normalize(F.col("t1")))[0][0] == 2).all()
    with pytest.raises(Exception, match="deviation"):
        run(d, it.standardize(F.col("t1")))
    with pytest.raises(Exception, match="cropping"):
        run(d, sp.crop(F.col("t1"), 1))


def test_labels(df, volumes):
    s = F.col("seg")
    lab = lambda v: (v > 0).astype(int)
    close(run(df, lb.remap(s, {0: 1, 1: 0})), volumes, lambda v: 1 - lab(v))
    close(run(df, lb.remove(s, [1], 5)), volumes, lambda v: np.where(lab(v) == 1, 5, 0))
    close(run(df, lb.sequential(lb.remap(s, {1: 8}))), volumes, lab)
    close(run(df, lb.one_hot(s, 2)), volumes, lambda v: np.concatenate([1 - lab(v), lab(v)]))
    close(run(df, lb.arg_max(lb.one_hot(s, 3))), volumes, lab)


@pytest.mark.parametrize(("mode", "np_mode"), [("reflect", "reflect"), ("replicate", "edge"), ("circular", "wrap"), ("mean", "mean"), ("minimum", "minimum"), ("median", "median"), ("constant", "constant")])
def test_pad(df, volumes, mode, np_mode):
    pads = ((0, 0), (1, 2), (0, 1), (2, 0))
    got = run(df, sp.pad(F.col("t1"), (1, 2, 0, 1, 2, 0), mode, 7))
    stats = {"mean": np.mean, "minimum": np.min, "median": np.median}
    close(got, volumes, lambda v: np.pad(v, pads, constant_values=7 if mode == "constant" else stats[mode](v)) if mode in (*stats, "constant") else np.pad(v, pads, mode=np_mode))
    assert np.allclose(got[0][1][:3, 3], [9, 20, 24])


def test_index_transforms(df, volumes):
    x = F.col("t1")
    close(run(df, sp.crop(x, (1, 0, 1, 1, 0, 2))), volumes, lambda v: v[:, 1:, 1:-1, :-2])
    close(run(df, sp.flip(x, (0, 2))), volumes, lambda v: v[:, ::-1, :, ::-1])
    close(run(df, sp.transpose(x)), volumes, lambda v: v.transpose(0, 3, 2, 1))
    close(run(df, sp.crop_or_pad(x, SHAPE[1:], (5, 3, None))), volumes, lambda v: np.pad(v, ((0, 0), (1, 1), (0, 0), (0, 0)))[:, :, 1:])
    turned = run(df, sp.reorient(x, "RAS", "PIR"))
    close(turned, volumes, lambda v: v[:, :, ::-1, ::-1].transpose(0, 2, 3, 1))
    back = run(df, sp.reorient(sp.reorient(x, "RAS", "PIR"), "PIR", "RAS"))
    close(back, volumes, lambda v: v)
    assert np.allclose(back[0][1], np.array([[1, 0, 0, 10], [0, 2, 0, 20], [0, 0, 3, 30], [0, 0, 0, 1]]))
    close(run(df, sp.resize(x, (5, 4, 2))), volumes, lambda v: kn.linear_axis(kn.linear_axis(v, 1, 5), 3, 2))
    assert sp.multiple_shape((3, 4, 5), (2, 4, 3)) == (4, 4, 6) and sp.multiple_shape((3, 4, 5), 2, "crop") == (2, 4, 4)


def test_border_mean_and_otsu(df, volumes):
    rows = df.select("subject_id", sp.border_mean(F.col("t1")).alias("b"), it.otsu(F.col("t1")).alias("o")).collect()
    for r in rows:
        v = volumes[r["subject_id"]][0]
        faces = np.concatenate([np.take(v, i, axis=d).ravel() for d in range(3) for i in (0, -1)])
        s = np.sort(v.ravel())
        n = len(s)
        gain = [k / n * (1 - k / n) * (s[:k].mean() - s[k:].mean()) ** 2 for k in range(1, n)]
        assert math.isclose(r["b"], faces.mean()) and math.isclose(r["o"], s[int(np.argmax(gain))])


def test_kernels(volumes):
    v = volumes[0]
    flat = np.ones(SHAPE)
    assert np.allclose(kn.blur(flat, (1, 1, 1)), 1) and abs(kn.blur(v, (1, 0, 0)).mean() - v.mean()) < 0.5
    cube = np.zeros((1, 10, 10, 10))
    cube[0, 3:7, 3:7, 3:7] = 1
    edge = kn.contour(cube)
    assert edge[0, 3, 4, 4] == 1 and edge[0, 4, 4, 4] == 0 and edge[0, 0, 5, 5] == 1 and edge[0, 2, 5, 5] == 0
    two = np.zeros((1, 12, 12, 12))
    two[0, 1:3, 1:3, 1:3] = two[0, 5:10, 5:10, 5:10] = 1
    kept = kn.keep_largest(two)
    assert kept.sum() == 125 and kept[0, 1, 1, 1] == 0
    chain = np.zeros((1, 3, 3, 3))
    chain[0, 0, 0, 0] = chain[0, 1, 1, 1] = chain[0, 2, 2, 2] = 1
    assert kn.keep_largest(chain).sum() == 3 and kn.keep_largest(chain, full=False).sum() == 1
    assert np.allclose(kn.ghosting(v, 2, 0, 0.0), v) and np.allclose(kn.spike(v, [(0.5, 0.5, 0.5)], 0.0), v)
    eye = np.eye(4)
    assert np.allclose(kn.warp(v, eye), v)
    assert np.allclose(kn.warp(v, eye, kn.affine_matrix(SHAPE[1:], eye, (1, 1, 1), (0, 0, 0), (1, 0, 0)))[:, 1:], v[:, :-1])
    assert np.allclose(kn.motion(v, [(0, 0, 0)] * 2, [(0, 0, 0)] * 2), v)
    with pytest.raises(ValueError):
        kn.motion(v, [(0, 0, 0)] * 3, [(0, 0, 0)] * 3)
    assert np.allclose(kn.add_bias(kn.add_bias(v, 1, 0.5, 0.5, 3), 1, 0.5, 0.5, 3, inverse=True), v)
    x = np.random.default_rng(1).normal(size=(4, 6, 6, 1))
    p = kn.pca(x, 3, normalize=False, values=(0, 1), clip=False)
    assert np.allclose(np.cov(p.reshape(3, -1)), np.eye(3), atol=1e-8)
    with pytest.raises(ValueError):
        kn.pca(x, 5)
    pairs = kn.swap_pairs((6, 6, 6), (2, 2, 2), 5, rng.Draws(0, 1))
    s = kn.swap(np.arange(216.0).reshape(1, 6, 6, 6), pairs, (2, 2, 2))
    assert sorted(s.ravel()) == list(range(216))
    c = kn.control_points((7, 7, 7), 2.0, 2, rng.Draws(0, 0))
    assert (c[:2] == 0).all() and (c[:, :, -1] == 0).all() and np.abs(c[3]).max() <= 2
    lab = np.arange(8).reshape(1, 2, 2, 2)
    assert (kn.partial_volume(lab, kn.grid((2, 2, 2))) == lab).all()


def test_random_numbers_ignore_partitions(spark):
    col = rng.normal(1, "s", F.col("id")).alias("z")
    one, many = (sorted(map(tuple, spark.range(0, 500, 1, n).select("id", col).collect())) for n in (1, 7))
    z = np.array([r[1] for r in one])
    assert one == many and abs(z.mean()) < 0.15 and abs(z.std() - 1) < 0.15


def test_geometry(spark):
    m = np.array([[0, -2, 0, 5], [1.5, 0, 0, -1], [0, 0, 3, 2], [0, 0, 0, 1.0]])
    a = F.array(*map(F.lit, m.ravel().tolist()))
    r = spark.range(1).select(A.inverse(a).alias("i"), A.orientation(a).alias("o"), F.array(*A.euler(a)).alias("e"), F.array(*A.spacing(a)).alias("s")).head()
    assert np.allclose(np.array(r["i"]).reshape(4, 4), np.linalg.inv(m)) and r["o"] == "ALS"
    assert np.allclose(r["e"], [0, 0, 90]) and np.allclose(r["s"], [1.5, 2, 3])
    assert A.axis_mapping("RAS", "LIP") == ([0, 2, 1], [-1, -1, -1])
    for bad in ("RRS", "RA", "IJR"):
        with pytest.raises(ValueError):
            A.axis_mapping("RAS", bad)
    box = [F.lit(float(v)) for v in (0, 1, 2, 4, 5, 8)]
    got = spark.range(1).select(F.array(*an.center_to_corners(an.corners_to_center(box))).alias("b"), F.array(*an.corners_to_axes(box, "RAS", "LAS")).alias("f")).head()
    assert got["b"] == [0, 1, 2, 4, 5, 8] and got["f"] == [-4, 1, 2, 0, 5, 8]


def test_patches(df, volumes):
    patches = pt.grid_patches(df, "t1", (2, 2, 3), (1, 0, 1))
    for mode in ("average", "crop"):
        rows = pt.aggregate_patches(patches, SHAPE[1:], (2, 2, 3), mode, (1, 0, 1)).collect()
        assert len(rows) == 3 * 60
        assert all(math.isclose(r["v"], volumes[r["subject_id"]].ravel()[r["p"]]) for r in rows)
    at = [(r["i0"], r["j0"], r["k0"]) for r in pt.grid_locations(df, "t1", (2, 3, 3)).where("subject_id = 0").orderBy("patch_ord").collect()]
    assert at == [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 2)]
    for r in pt.weighted_patches(df, "t1", "seg", (1, 1, 1), 20).collect():
        assert volumes[r["subject_id"]][0, r["i0"], r["j0"], r["k0"]] > 0
    for r in pt.uniform_patches(df, "t1", (2, 2, 2), 20).collect():
        assert 0 <= r["i0"] <= 1 and 0 <= r["j0"] <= 2 and 0 <= r["k0"] <= 3
    with pytest.raises(Exception, match="larger"):
        pt.grid_patches(df, "t1", (9, 9, 9)).collect()


def test_queue_buffers(spark):
    rows = spark.range(40).select(F.col("id").alias("subject_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("patch_ord"))
    q = pt.queue(rows, per_subject=3, buffer_subjects=8).collect()
    assert len(q) == 120 and all(r["buffer"] == r["subject_id"] // 8 for r in q)
    assert sorted(r["place"] for r in q if r["buffer"] == 2) == list(range(24))


def test_plans(df, volumes):
    steps = Compose([Transform("Gamma", {"log_gamma": [-0.2, 0.2]}), Transform("Flip", {"axes": 1}, p=0.5), Transform("Pad", {"padding": 1}, include=["t1"])])
    out = steps(df, seed=3)
    assert from_json(steps.to_json()).to_json() == steps.to_json()
    close({r: v for r, v in run(steps.inverse(out), F.col("t1")).items()}, volumes, lambda v: v)
    for r in out.select("history").collect():
        names = [h["name"] for h in r["history"]]
        assert names[0] == "Gamma" and names[-1] == "Pad" and -0.2 <= json.loads(r["history"][0]["params"])["log_gamma"] <= 0.2
    either = Compose([OneOf([Transform("Clamp", {"out_min": 0.0}), Transform("Clamp", {"out_max": 0.0})]), SomeOf([Transform("Transpose"), Transform("Flip")], 1, 1)])
    assert all(len(r["history"]) == 2 for r in either(df).select("history").collect())
    with pytest.raises(ValueError):
        Transform("Nothing")
    with pytest.raises(ValueError):
        Transform("Clamp", {"wrong": 1})
    with pytest.raises(ValueError):
        draw3((1, 2, 3, 4), 0, "s", F.lit(1))
    with pytest.warns(UserWarning):
        Transform("Gamma", {"log_gamma": 0})


@pytest.mark.parametrize("compress", [False, True])
def test_nifti_round_trip(spark, tmp_path, compress):
    r = np.random.default_rng(2)
    a = np.array([[0, 2, 0, 1], [1, 0, 0, 2], [0, 0, 3, 3], [0, 0, 0, 1.0]])
    volumes = {f"v{n}.nii" + (".gz" if compress else ""): r.integers(-9, 9, s).astype(k) for n, (s, k) in enumerate([((1, 3, 4, 5), "int16"), ((2, 3, 4, 5), "float32")])}
    for name, v in volumes.items():
        (tmp_path / name).write_bytes(nifti.encode(v, a, compress=compress))
    heads = {x["path"].rsplit("/", 1)[1]: x for x in nifti.read_headers(spark, str(tmp_path)).collect()}
    for x in nifti.read_images(spark, str(tmp_path)).collect():
        name, img = x["path"].rsplit("/", 1)[1], x["image"]
        v = volumes[name]
        assert (img["c"], img["si"], img["sj"], img["sk"]) == v.shape == tuple(heads[name][k] for k in ("c", "si", "sj", "sk"))
        assert np.array_equal(np.array(img["data"]).reshape(v.shape), v) and np.allclose(np.array(img["affine"]).reshape(4, 4), a)
        assert heads[name]["dtype"] == v.dtype.name


def test_write_images(df, volumes, spark, tmp_path):
    nifti.write_images(df, "t1", "subject_id", str(tmp_path / "out"))
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        v, a, kind = nifti.decode(bytes(r["content"]))
        assert kind == "float32" and np.allclose(v, volumes[r["key"]], atol=1e-6) and np.allclose(a[:3, 3], [10, 20, 30])


def test_matrix_files():
    m = np.array([[0.9, -0.1, 0, 4], [0.1, 0.9, 0, -2], [0, 0, 1.1, 7], [0, 0, 0, 1]])
    for kind in ("itk", "table"):
        assert np.allclose(generators.read_matrix(generators.write_matrix(m, kind)), m, atol=1e-6)


def test_streaming_queue(spark, tmp_path):
    rows = spark.range(30).select((F.col("id") % 10).alias("subject_id"), F.col("id").alias("patch_ord"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    patch_queue(spark, str(tmp_path / "in"), "subject_id long, patch_ord long", str(tmp_path / "out"), str(tmp_path / "ck"), keys=["subject_id", "patch_ord"]).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["patch_ord"] for r in got) == list(range(30)) and len({r["buffer"] for r in got}) == 3


def test_every_query_has_a_name():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 90
