"""Formats, region reads, bricks, folders, index rules, annotations between axes, patches put together, the command line."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.__main__ import main
from voxlake.functions import affine as A
from voxlake.functions.image import image
from voxlake.functions.slicing import normalize_index, parse_index
from voxlake.operators import annotations as an, patches as pt, volume as vo
from voxlake.sources import backends as be, nifti

AFFINE = np.array([[0, 2, 0, 1], [1, 0, 0, 2], [0, 0, 3, 3], [0, 0, 0, 1.0]])
INDICES = [":", "0", "-1", ":, 1:3", "..., -1", "0, ..., ::2", ":, -3:-1, 1", ":, ::-1", ":, 2, 0:2, 1:"]


def volume(shape=(2, 4, 5, 6), kind="float32"):
    return np.random.default_rng(3).integers(-90, 90, shape).astype(kind)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    for name, body in (("a.nii", nifti.encode(volume(), AFFINE)), ("b.nii.gz", nifti.encode(volume(), AFFINE, compress=True)), ("c.nrrd", be.write_nrrd(volume(), AFFINE)), ("d.nrrd", be.write_nrrd(volume((1, 4, 5, 6), "int16"), AFFINE, compress=True))):
        (top / name).write_bytes(body)
    np.save(top / "e.npy", volume())
    (top / "notes.txt").write_text("no volume")
    return str(top)


def taken(row):
    x = row["image"]
    return np.array(x["data"]).reshape(x["c"], x["si"], x["sj"], x["sk"]), np.array(x["affine"]).reshape(4, 4)


def test_formats_by_suffix(spark, folder):
    heads = {r["path"].rsplit("/", 1)[1]: r for r in be.scan(spark, folder, header=True).collect()}
    assert sorted(heads) == ["a.nii", "b.nii.gz", "c.nrrd", "d.nrrd", "e.npy"] and heads["d.nrrd"]["dtype"] == "int16" and heads["c.nrrd"]["c"] == 2
    rows = be.scan(spark, folder).collect()
    assert len(rows) == 5
    for r in rows:
        x, a = taken(r)
        want = volume((1, 4, 5, 6), "int16") if r["path"].endswith("d.nrrd") else volume()
        assert np.array_equal(x, want) and np.allclose(a, np.eye(4) if r["path"].endswith("npy") else AFFINE)
    assert be.scan(spark, f"{folder}/a.nii").count() == 1 and be.scan(spark, folder, glob="*.nrrd").count() == 2
    with pytest.raises(ValueError, match="no format"):
        be.backend_of("x.txt")
    with pytest.raises(Exception, match="no format"):
        be.scan(spark, f"{folder}/notes.txt").count()
    with pytest.raises(Exception, match="FileNotFound"):
        be.scan(spark, f"{folder}/nothing").count()


@pytest.mark.parametrize("index", INDICES)
def test_regions_equal_slices_of_the_whole(folder, index):
    at = normalize_index(parse_index(index))
    for name in ("a.nii", "b.nii.gz", "c.nrrd", "e.npy"):
        with open(f"{folder}/{name}", "rb") as f:
            x, a = be.backend_of(name).load(f, at)
        s = vo.Subject({"t1": vo.Volume(volume(), np.eye(4) if name.endswith("npy") else AFFINE, False)}, ["t1"])
        vo.take(s, {"index": index, "spatial": False})
        assert np.array_equal(x, volume()[at]) and np.allclose(a, s.images["t1"].affine)


def test_region_reads_little(folder):
    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n=-1):
            data = self.f.read(n)
            self.n += len(data)
            return data

        def seek(self, at):
            return self.f.seek(at)

    with open(f"{folder}/a.nii", "rb") as f:
        counting = Counting(f)
        be.BACKENDS[".nii"].load(counting, normalize_index((0, slice(1, 3), 2, 3)))
        assert counting.n <= 352 + 2 + 4 * 2 * 4
        counting.n = 0
        f.seek(0)
        be.BACKENDS[".nii"].head(counting)
        assert counting.n <= 354


def test_region_through_spark_and_own_formats(spark, folder):
    x, a = taken(be.scan(spark, f"{folder}/a.nii", region="1, 1:3, ..., -1").head())
    assert np.array_equal(x, volume()[1:2, 1:3, :, -1:])
    text = be.scan(spark, folder, glob="*.txt", reader=lambda f: (np.full((1, 2, 2, 2), len(f.read())), np.eye(4))).collect()
    assert len(text) == 1 and taken(text[0])[0].max() == 9
    be.register_backend(".txt", be.Backend(lambda f: be._head_of(np.zeros((1, 1, 1, 1)), np.eye(4)), lambda f, index: (np.zeros((1, 1, 1, 1)), np.eye(4))))
    try:
        assert be.scan(spark, folder).count() == 6
    finally:
        be.BACKENDS.pop(".txt")


def test_index_rules():
    assert normalize_index(2) == (slice(2, 3), *[slice(None)] * 3) and normalize_index(-1)[0] == slice(-1, None)
    assert normalize_index((0, ..., 1)) == (slice(0, 1), slice(None), slice(None), slice(1, 2)) and normalize_index(...) == (slice(None),) * 4
    for bad, error in (((0, ..., ...), IndexError), ((0,) * 5, IndexError), ("x", TypeError), ((1.5,), TypeError), (True, TypeError)):
        with pytest.raises(error):
            normalize_index(bad)
    s = vo.Subject({"a": vo.Volume(np.zeros((1, 2, 2, 2)), np.eye(4), False), "b": vo.Volume(np.zeros((1, 3, 2, 2)), np.eye(4), False)}, ["a", "b"])
    with pytest.raises(RuntimeError):
        vo.take(s, {"index": "0", "spatial": True})
    with pytest.raises(ValueError):
        vo.take(s, {"index": ":, 5:", "spatial": False})


def test_bricks_and_regions(spark, tmp_path):
    r = np.random.default_rng(1)
    volumes = {i: r.normal(size=(2, 5, 6, 7)) for i in range(3)}
    d = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in volumes.items()], "subject_id long, d array<double>")
    df = d.select("subject_id", image(2, 5, 6, 7, A.from_spacing([1, 2, 3], [10, 20, 30]), F.col("d")).alias("t1"))
    cut = be.bricks(df, "t1", "subject_id", (2, 6, 3))
    assert cut.count() == 3 * 3 * 1 * 3
    cut.write.parquet(str(tmp_path / "bricks"))
    stored = spark.read.parquet(str(tmp_path / "bricks"))
    for region, want in (("1:4, 2:5, 3:", (slice(1, 4), slice(2, 5), slice(3, None))), (":, :, :", (slice(None),) * 3), ("4, 5, 6", (slice(4, 5), slice(5, 6), slice(6, 7)))):
        for row in be.read_region(stored, (2, 6, 3), region).collect():
            x, a = taken(row)
            assert np.allclose(x, volumes[row["key"]][(slice(None), *want)])
            assert np.allclose(a[:3, 3], [10 + (want[0].start or 0), 20 + 2 * (want[1].start or 0), 30 + 3 * (want[2].start or 0)])
    plan = be.read_region(stored, (2, 6, 3), "0:2, 0:2, 0:2")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(bi)" in plan or "LessThanOrEqual(bi,0)" in plan
    with pytest.raises(ValueError):
        be.read_region(stored, (2, 6, 3), "::2, :, :")


def test_files_of_subjects_and_folders(spark, tmp_path):
    d = spark.range(4).select(F.col("id").alias("subject_id"), image(1, 2, 2, 2, A.from_spacing([1, 1, 1], [0, 0, 0]), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: (x * F.col("id")).cast("double"))).alias("t1"))
    for name, rows in (("t1", d), ("t2", d.where("subject_id <> 2"))):
        be.save_files(rows.withColumn("f", F.concat(F.lit("S"), "subject_id", F.lit(f"-{name}"))), "t1", "f", str(tmp_path / "set" / name), ".nii.gz").count()
    both = {r["subject_id"]: r for r in be.scan_modalities(spark, str(tmp_path / "set"), ["t1", "t2"]).collect()}
    assert sorted(both) == ["S0", "S1", "S3"] and both["S3"]["t1"]["data"][7] == 24
    a, b = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i long, g string"), spark.createDataFrame([(10, "x"), (20, "x"), (30, "y")], "j long, g string")
    assert {(r["i"], r["j"]) for r in be.zip_strict(a, b, "i", "j", "g").collect()} == {(1, 10), (2, 20), (3, 30)}
    with pytest.raises(Exception, match="unequal"):
        be.zip_strict(a, b.where("j > 10"), "i", "j", "g").collect()


def test_axes_between_voxels_and_anatomy(spark):
    m = np.array([[0, -2, 0, 5], [1.5, 0, 0, -1], [0, 0, 3, 2], [0, 0, 0, 1.0]])  # codes ALS
    a = F.array(*map(F.lit, m.ravel().tolist()))
    p = [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    row = lambda cols: spark.range(1).select(F.array(*cols).alias("v")).head()["v"]
    world = m[:3, :3] @ [1, 2, 3] + m[:3, 3]
    assert np.allclose(row(an.to_axes(p, "IJK", "ALS", affine=a)), world)  # the affine's own orientation
    assert np.allclose(row(an.to_axes(p, "IJK", "RPS", affine=a)), [-world[1], -world[0], world[2]])
    back = an.to_axes(an.to_axes(p, "KJI", "SRA", affine=a), "SRA", "KJI", affine=a)
    assert np.allclose(row(back), [1, 2, 3])
    box = [F.lit(float(v)) for v in (0, 1, 2, 4, 5, 8)]
    there = an.to_format(box, ("IJK", "corners"), ("RAS", "center_size"), a)
    d = spark.range(1).select(F.array(*there).alias("b"))
    again = an.to_format(an.parts(F.col("b"), 6), ("RAS", "center_size"), ("IJK", "corners"), a)
    assert np.allclose(d.select(F.array(*again).alias("v")).head()["v"], [0, 1, 2, 4, 5, 8])
    with pytest.raises(ValueError):
        an.to_format(box, ("IJK", "edges"), ("IJK", "corners"))


def test_put_together_many_channels():
    x = np.random.default_rng(2).normal(size=(3, 5, 5, 5))
    places = np.array([(i, j, k) for i in (0, 2) for j in (0, 2) for k in (0, 2)])
    parts = [x[:, i : i + 3, j : j + 3, k : k + 3] for i, j, k in places]
    for mode in ("average", "crop"):
        assert np.allclose(pt.put_together(parts, places, (5, 5, 5), (3, 3, 3), mode, (1, 1, 1)), x)
    w = pt.hann_window((3, 3, 3))
    total = np.zeros((5, 5, 5))
    for i, j, k in places:
        total[i : i + 3, j : j + 3, k : k + 3] += w
    assert np.allclose(pt.put_together(parts, places, (5, 5, 5), (3, 3, 3), "hann"), x * total / np.maximum(total, 1))
    assert np.isnan(pt.put_together(parts[:1], places[:1], (5, 5, 5), (3, 3, 3), "average")[:, 4, 4, 4]).all()


def test_patch_places(spark):
    got = spark.range(1).select(*(F.array(*c).alias(n) for c, n in zip(pt.scaled([F.lit(3), F.lit(5), F.lit(1)], [F.lit(4)] * 3, (0.5, 2.0, 1.0)), "is", strict=True))).head()
    assert got["i"] == [2, 10, 1] and got["s"] == [2, 8, 4]
    rows = spark.range(10).select(F.col("id").alias("subject_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("patch_ord"))
    assert {r["buffer"] for r in pt.queue(rows, per_subject=4, max_length=10).collect()} == {0, 1, 2, 3}


def test_command_line(folder, tmp_path, capsys):
    main(["info", f"{folder}/a.nii"])
    info = json.loads(capsys.readouterr().out)
    assert info == {"shape": [2, 4, 5, 6], "dtype": "float32", "spacing": [1.0, 2.0, 3.0], "origin": [1.0, 2.0, 3.0], "orientation": "ARS"}
    for name in ("x.nrrd", "x.nii.gz", "x.npy"):
        main(["convert", f"{folder}/a.nii", str(tmp_path / name)])
        with open(tmp_path / name, "rb") as f:
            x, a = be.backend_of(name).load(f, None)
        assert np.array_equal(x, volume())


def test_batches(spark):
    from voxlake.operators import batches as bt

    one = lambda n: image(1, n, 2, 2, A.from_spacing([1, 1, 1], [0, 0, 0]), F.transform(F.sequence(F.lit(1), n * 4), lambda x: (x * F.col("id")).cast("double")))
    df = spark.range(0, 23, 1, 5).select(F.col("id").alias("subject_id"), one(F.lit(2)).alias("t1"))
    stacked = bt.stack(df, ["t1"], 5)
    assert sorted((r["batch"], r["n"]) for r in stacked.collect()) == [(0, 5), (1, 5), (2, 5), (3, 5), (4, 3)]
    back = {r["subject_id"]: (r["batch"], r["place"], r["t1"]) for r in bt.unstack(stacked, ["t1"]).collect()}
    assert all(back[r["subject_id"]] == (r["subject_id"] // 5, r["subject_id"] % 5, r["t1"]) for r in df.collect())
    mixed = spark.range(4).select(F.col("id").alias("subject_id"), one((F.col("id") + 1).cast("int")).alias("t1"))
    with pytest.raises(Exception, match="several shapes"):
        bt.stack(mixed, ["t1"], 4).collect()
    with pytest.raises(ValueError):
        bt.consistent(["t1"], "colour")
