"""The registered queries of the volumetric engine, each with the DuckDB SQL that gives the same rows where SQL can.

Images are the 4 x 4 x 4 volumes of ``embeddings``. Results are plain columns: (vec_id, p, v) for voxels, with p the
position in the result's own shape; floating-point values are rounded to 6 places.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import affine as A, rng
from ..functions.image import image, let, replace
from ..operators import annotations as an, batches as bt, intensity as it, kernels as kn, label as lb, patches as pt, spatial as sp, statistics as st
from ..sources import backends as be
from ..sources.generators import zone_plate
from ..sources.tables import multichannel, subjects, table
from ..streaming.queue import event_counts
from .compose import Compose, OneOf, SomeOf, Transform, invert_history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# all voxels with their value and indices
VOX = "SELECT vec_id, label, p, p // 16 AS i, (p // 4) % 4 AS j, p % 4 AS k, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS p)"
SEG = "CASE WHEN v > 0.1 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END"
WITH = f"WITH x AS ({VOX})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def real(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def dump(df: DataFrame, img: Column, whole: bool = False) -> DataFrame:
    rows = df.select(F.col("subject_id").alias("vec_id"), F.posexplode(img["data"]).alias("p", "v"))
    v = F.col("v").cast("bigint") if whole else real(F.col("v").cast("double"))
    return rows.select("vec_id", F.col("p").cast("bigint").alias("p"), v.alias("v"))


def rsql(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


def voxel_sql(e: str, where: str = "") -> str:
    """Each voxel's value e."""
    return f"{WITH} SELECT vec_id, p, {rsql(e)} AS v FROM x {where}"


def gather_sql(n: int, src: str, fill: str | None = None, where: str = "true") -> str:
    """n voxels g of each image, from position src (an expression of g), or fill where ``where`` is false."""
    v = f"CAST(embedding[CAST({src} AS INTEGER) + 1] AS DOUBLE)"
    v = v if fill is None else f"CASE WHEN {where} THEN {v} ELSE {fill} END"
    return f"SELECT vec_id, g AS p, {rsql(v)} AS v FROM embeddings, (SELECT unnest(range({n})) AS g)"


def simple(name: str, f: Callable, sql: str, whole: bool = False, column: str = "t1") -> None:
    """A query that maps one image column of the subjects."""
    QUERIES[name] = lambda spark, sf_dir: dump(s := subjects(spark, sf_dir), f(F.col(column), s), whole)
    ORACLES[name] = sql


# --- scans, slices, predicates ---
simple("scan_voxels", lambda x, s: x, voxel_sql("v"))


@query("SELECT vec_id, CAST(1 AS BIGINT) AS c, CAST(4 AS BIGINT) AS si, CAST(4 AS BIGINT) AS sj, CAST(4 AS BIGINT) AS sk, CAST(label AS DOUBLE) AS ox, CAST(1 + label % 3 AS DOUBLE) AS dz FROM embeddings")
def scan_header(spark, sf_dir):
    s = subjects(spark, sf_dir)
    return s.select(F.col("subject_id").alias("vec_id"), *(F.col(f"t1.{n}").cast("bigint").alias(n) for n in ("c", "si", "sj", "sk")), A.origin(F.col("t1.affine"))[0].alias("ox"), A.spacing(F.col("t1.affine"))[2].alias("dz"))


simple("slice_region", lambda x, s: sp.crop(x, (1, 1, 0, 2, 2, 0)), gather_sql(8, "(g // 4 + 1) * 16 + (g // 2) % 2 * 4 + g % 2 + 2"))


@query("SELECT vec_id, CAST(label + 1 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(2 * (1 + label % 3) AS DOUBLE) AS z FROM embeddings")
def slice_affine_shift(spark, sf_dir):
    a = sp.crop(F.col("t1"), (1, 1, 0, 2, 2, 0))["affine"]
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), *(c.alias(n) for c, n in zip(A.origin(a), "xyz", strict=True)))


def _both(df: DataFrame) -> DataFrame:
    parts = [dump(df, F.col(n)).withColumn("name", F.lit(n)) for n in ("t1", "t2")]
    return parts[0].unionByName(parts[1])


@query(f"{WITH} SELECT vec_id, p, {rsql('least(v, 0.05)')} AS v, 't1' AS name FROM x UNION ALL SELECT vec_id, p, {rsql('v')}, 't2' FROM x")
def filter_include_exclude(spark, sf_dir):
    s = subjects(spark, sf_dir).withColumn("t2", F.col("t1"))
    return _both(Compose([Transform("Clamp", {"out_max": 0.05}, exclude=["t2"]), Transform("Clamp", {"out_max": -9.0}, include=["none"])])(s))


@query(f"{WITH} SELECT vec_id, p, {rsql('greatest(v, 0)')} AS v, CAST({SEG} AS BIGINT) AS seg FROM x")
def filter_kind(spark, sf_dir):
    out = Compose([Transform("Clamp", {"out_min": 0.0})])(subjects(spark, sf_dir))
    rows = out.select(F.col("subject_id").alias("vec_id"), F.posexplode(F.arrays_zip(F.col("t1.data").alias("v"), F.col("seg.data").alias("s"))).alias("p", "e"))
    return rows.select("vec_id", F.col("p").cast("bigint").alias("p"), real(F.col("e.v")).alias("v"), F.col("e.s").cast("bigint").alias("seg"))


@query(f"{WITH} SELECT vec_id, CAST(list_sort(list(DISTINCT {SEG})) AS VARCHAR) AS labels FROM x GROUP BY vec_id")
def label_unique(spark, sf_dir):
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), F.concat(F.lit("["), F.array_join(lb.unique(F.col("seg")), ", "), F.lit("]")).alias("labels"))


# --- intensity ---
simple("intensity_clamp", lambda x, s: it.clamp(x, -0.1, 0.1), voxel_sql("greatest(-0.1, least(0.1, v))"))
simple("intensity_gamma", lambda x, s: it.gamma(x, 0.3), voxel_sql("sign(v) * pow(abs(v), exp(0.3))"))
simple("intensity_gamma_inverse", lambda x, s: it.gamma(it.gamma(x, 0.3), -0.3), voxel_sql("v"))


def norm_sql(lo: str, hi: str, source: str = "x") -> str:
    return f"{WITH}, s AS (SELECT vec_id, {lo} AS lo, {hi} AS hi FROM {source} GROUP BY vec_id) SELECT vec_id, p, {rsql('CASE WHEN hi > lo THEN (least(greatest(v, lo), hi) - lo) / (hi - lo) * 2 - 1 ELSE v END')} AS v FROM x JOIN s USING (vec_id)"


simple("intensity_normalize_minmax", lambda x, s: it.normalize(x), norm_sql("min(v)", "max(v)"))
simple("intensity_normalize_percentile", lambda x, s: it.normalize(x, percentiles=(5, 95)), norm_sql("quantile_cont(v, 0.05)", "quantile_cont(v, 0.95)"))
simple("intensity_normalize_window", lambda x, s: it.normalize(x, 0.0, 1.0, in_range=(-0.2, 0.2)), voxel_sql("(least(greatest(v, -0.2), 0.2) + 0.2) / 0.4"))
simple("intensity_normalize_masked", lambda x, s: it.normalize(x, percentiles=(5, 95), mask=F.col("brain")), norm_sql("quantile_cont(v, 0.05)", "quantile_cont(v, 0.95)", "(SELECT * FROM x WHERE v > 0)"))


def standard_sql(source: str = "x") -> str:
    return f"{WITH}, s AS (SELECT vec_id, avg(v) AS m, stddev_samp(v) AS d FROM {source} GROUP BY vec_id) SELECT vec_id, p, {rsql('(v - m) / d')} AS v FROM x JOIN s USING (vec_id)"


simple("intensity_standardize", lambda x, s: it.standardize(x), standard_sql())
simple("intensity_standardize_masked", lambda x, s: it.standardize(x, F.col("brain")), standard_sql("(SELECT * FROM x WHERE v > 0)"))
simple("intensity_mask", lambda x, s: it.apply_mask(x, F.col("brain"), outside=-1.0), voxel_sql("CASE WHEN v > 0 THEN v ELSE -1.0 END"))
simple("intensity_mask_labels", lambda x, s: it.apply_mask(x, F.col("seg"), labels=[1]), voxel_sql(f"CASE WHEN {SEG} = 1 THEN v ELSE 0.0 END"))
_N1, _N2 = (rng.voxel_normal_sql(3, f"noise{k}", "vec_id", "p") for k in (1, 2))
simple("intensity_noise_gaussian", lambda x, s: it.noise(x, F.col("subject_id"), std=0.25, seed=3), voxel_sql(f"v + {_N1} * 0.25"))
simple("intensity_noise_rician", lambda x, s: it.noise(x, F.col("subject_id"), std=0.25, rician=True, seed=3), voxel_sql(f"sqrt(pow(v + {_N1} * 0.25, 2) + pow({_N2} * 0.25, 2))"))


def piped(name: str, steps: Callable[[], Compose], sql: str, seed: int = 0, whole: bool = False, column: str = "t1", back: bool = False) -> None:
    """A query that runs a pipeline on the subjects (and undoes it) and gives one image."""

    def run(spark, sf_dir):
        out = steps()(subjects(spark, sf_dir), seed=seed)
        return dump(invert_history(out) if back else out, F.col(column), whole)

    QUERIES[name], ORACLES[name] = run, sql


piped("intensity_noise_gated", lambda: Compose([Transform("Noise", {"std": [0.1, 0.3]}, p=0.5)]), voxel_sql(f"CASE WHEN {rng.uniform_sql(5, '/0.p', 'vec_id')} < 0.5 THEN v + {rng.voxel_normal_sql('5|/0', 'noise1.t1', 'vec_id', 'p')} * (0.1 + 0.2 * {rng.uniform_sql(5, '/0.std', 'vec_id')}) ELSE v END"), seed=5)
# the coarse grid has at least 4 voxels an axis, as many as the image
piped("intensity_bias_field", lambda: Compose([Transform("BiasField", {"std": 0.5, "scale": 0.5})]), voxel_sql(f"v * exp(0.5 * {rng.voxel_normal_sql('7|/0', 'bias.t1', 'vec_id', 'p')})"), seed=7)


def _blur_weights(s: float) -> str:
    r = max(math.ceil(3 * s), 1)
    w = [math.exp(-0.5 * (t / s) ** 2) for t in range(-r, r + 1)]
    return "(VALUES " + ", ".join(f"({t}, CAST({x / sum(w)!r} AS DOUBLE))" for t, x in zip(range(-r, r + 1), w, strict=True)) + ")"


@query(
    f"{WITH}, w AS (SELECT * FROM {_blur_weights(0.8)} t(o, w)), a AS (SELECT x.vec_id, x.p, sum(w.w * y.v) AS v FROM x, w, x y WHERE y.vec_id = x.vec_id AND y.i = greatest(0, least(3, x.i + o)) AND y.j = x.j AND y.k = x.k GROUP BY ALL), "
    f"b AS (SELECT a.vec_id, a.p, sum(w.w * y.v) AS v FROM a, w, a y WHERE y.vec_id = a.vec_id AND y.p = a.p // 16 * 16 + greatest(0, least(3, (a.p // 4) % 4 + o)) * 4 + a.p % 4 GROUP BY ALL), "
    f"c AS (SELECT b.vec_id, b.p, sum(w.w * y.v) AS v FROM b, w, b y WHERE y.vec_id = b.vec_id AND y.p = b.p // 4 * 4 + greatest(0, least(3, b.p % 4 + o)) GROUP BY ALL) SELECT vec_id, p, {rsql('v')} AS v FROM c"
)
def intensity_blur(spark, sf_dir):
    s = subjects(spark, sf_dir)
    return dump(s, kn.kernel(lambda v: kn.blur(v, (0.8, 0.8, 0.8)), F.col("t1")))


_Q = ", ".join(str(q) for q in it.QUANTILES)
_LAND = f"q AS (SELECT vec_id, quantile_cont(v, [{_Q}]) AS q FROM x GROUP BY vec_id), s AS (SELECT q, coalesce(100.0 / nullif(q[13] - q[1], 0), 0) AS s FROM q), m AS (SELECT n, avg(s * q[n]) + avg(-s * q[1]) AS y FROM s, (SELECT unnest(range(1, 14)) AS n) GROUP BY n)"


@query(f"{WITH}, {_LAND} SELECT CAST([{_Q}][n] AS DOUBLE) AS quantile, {rsql('y')} AS value FROM m")
def intensity_hist_landmarks(spark, sf_dir):
    return it.landmarks(subjects(spark, sf_dir), "t1").select(F.col("quantile").cast("double").alias("quantile"), real(F.col("value")).alias("value"))


_MARKS = [float(round(100 * q, 3)) for q in it.QUANTILES]
_EDGES = " + ".join(f"CAST(v > q[{n}] AS INT)" for n in range(2, 13))


@query(
    f"{WITH}, q AS (SELECT vec_id, quantile_cont(v, [{_Q}]) AS q FROM x GROUP BY vec_id), g AS (SELECT vec_id, p, v, q, 1 + {_EDGES} AS n, {_MARKS} AS m FROM x JOIN q USING (vec_id)), "
    f"l AS (SELECT *, CASE WHEN abs(q[n + 1] - q[n]) < 1e-5 THEN 0.0 ELSE (m[n + 1] - m[n]) / (q[n + 1] - q[n]) END AS s FROM g) SELECT vec_id, p, {rsql('s * v + (m[n] - s * q[n])')} AS v FROM l"
)
def intensity_hist_standardize(spark, sf_dir):
    s = subjects(spark, sf_dir)
    return dump(s, it.histogram_standardize(F.col("t1"), _MARKS))


def _dft(axis: str, factor: list[float]) -> str:
    """The image after weighting the (unshifted) frequencies along an axis of 4."""
    terms = " + ".join(f"{w} * cos(2 * pi() * {f} * (x.{axis} - y.{axis}) / 4.0)" for f, w in enumerate(factor))
    same = " AND ".join(f"x.{a} = y.{a}" for a in "ijk" if a != axis)
    return f"{WITH} SELECT x.vec_id, x.p, {rsql(f'sum(y.v * ({terms})) / 4.0')} AS v FROM x JOIN x y ON x.vec_id = y.vec_id AND {same} GROUP BY x.vec_id, x.p"


# planes 0 and 2 of the shifted spectrum, that is frequencies 2 and 0, keep half
simple("intensity_ghosting", lambda x, s: kn.kernel(lambda v: kn.ghosting(v, 2, 0, 0.5), x), _dft("i", [0.5, 1.0, 0.5, 1.0]))


# the spectrum by a table of cosines and sines of the four phases, list by list
_PHASE = "((u // 16) * (p // 16) + (u // 4) % 4 * ((p // 4) % 4) + u % 4 * (p % 4)) % 4"


@query(
    f"WITH w AS (SELECT u, list([1, 0, -1, 0][{_PHASE} + 1] ORDER BY p) AS c, list([0, 1, 0, -1][{_PHASE} + 1] ORDER BY p) AS s FROM (SELECT unnest(range(64)) AS u), (SELECT unnest(range(64)) AS p) GROUP BY u), "
    "m AS (SELECT vec_id, max(sqrt(pow(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(c AS DOUBLE[])), 2) + pow(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(s AS DOUBLE[])), 2))) AS peak FROM embeddings, w GROUP BY vec_id), "
    f"x AS ({VOX}) SELECT vec_id, p, {rsql('v + peak * 0.1 * cos(2 * pi() * (i + 2 * j) / 4.0) / 64')} AS v FROM x JOIN m USING (vec_id)"
)
def intensity_spike(spark, sf_dir):
    # place (3, 0, 2) of the shifted spectrum is the frequency (1, -2, 0)
    s = subjects(spark, sf_dir)
    return dump(s, kn.kernel(lambda v: kn.spike(v, [(0.75, 0.0, 0.5)], 0.1), F.col("t1")))


# a turn by 5 degrees about the first of the axes k, j, i and a shift of (0.5, 0, 0) voxels, which is 0.25 along k; frequencies 2 and 3 come from the moved copy
_TURN = f"CAST({math.cos(math.radians(5))!r} AS DOUBLE)", f"CAST({math.sin(math.radians(5))!r} AS DOUBLE)"
_SHARE = "(cos(pi() * {0} * (a.i - b.i) / 2) + cos(pi() * {1} * (a.i - b.i) / 2)) / 4"


@query(
    f"{WITH}, g AS (SELECT vec_id, p, i, j, k, v, {_TURN[1]} * (j - 1.5) + {_TURN[0]} * (i - 1.5) + 1.5 AS x0, {_TURN[0]} * (j - 1.5) - {_TURN[1]} * (i - 1.5) + 1.5 AS y0, k + 0.25 * 1.5 AS z0 FROM x), "
    "c AS (SELECT unnest(range(8)) AS c), n AS (SELECT g.vec_id, g.p, floor(x0) + c // 4 AS i, floor(y0) + (c // 2) % 2 AS j, floor(z0) + c % 2 AS k, x0, y0, z0 FROM g, c), "
    "h AS (SELECT n.vec_id, n.p, sum((1 - abs(x0 - n.i)) * (1 - abs(y0 - n.j)) * (1 - abs(z0 - n.k)) * coalesce(x.v, 0)) AS w FROM n LEFT JOIN x ON n.vec_id = x.vec_id AND n.i = x.i AND n.j = x.j AND n.k = x.k GROUP BY ALL), "
    f"y AS (SELECT g.vec_id, g.p, g.i, g.p % 16 AS q, g.v, h.w FROM g JOIN h USING (vec_id, p)) SELECT a.vec_id, a.p, {rsql(f'sum({_SHARE.format(0, 1)} * b.v + {_SHARE.format(2, 3)} * b.w)')} AS v FROM y a JOIN y b ON a.vec_id = b.vec_id AND a.q = b.q GROUP BY ALL"
)
def intensity_motion(spark, sf_dir):
    steps = Compose([Transform("Motion", {"degrees": (5.0, 0.0, 0.0), "translation": (0.5, 0.0, 0.0), "num_transforms": 1})])
    return dump(steps(subjects(spark, sf_dir)), F.col("t1"))


simple("intensity_swap", lambda x, s: kn.kernel(lambda v: kn.swap(v, [((0, 0, 0), (2, 2, 2))], (2, 2, 2)), x), gather_sql(64, "CASE WHEN g // 16 < 2 AND (g // 4) % 4 < 2 AND g % 4 < 2 THEN g + 42 WHEN g // 16 >= 2 AND (g // 4) % 4 >= 2 AND g % 4 >= 2 THEN g - 42 ELSE g END"))


def _swap_sql(pairs: int) -> str:
    """Three pairs of 2 x 2 x 2 patches, each exchanged after the other; a voxel's source is found from the last pair to the first."""
    parts = ["d AS (SELECT vec_id, n, t, " + ", ".join(f"CAST(floor(3 * (CASE n " + " ".join(f"WHEN {n} THEN {rng.voxel_uniform_sql('1|/0', f'swap{n}', 'vec_id', f'(t * 3 + {d})')}" for n in range(pairs)) + f" END)) AS INT) AS {a}" for d, a in enumerate("xyz")) + f" FROM embeddings, (SELECT unnest(range({pairs})) AS n), (SELECT unnest(range(101)) AS t))"]
    parts.append("o AS (SELECT * FROM d WHERE t = 0), e AS (SELECT d.vec_id, d.n, coalesce(min(d.t) FILTER (abs(d.x - o.x) >= 2 OR abs(d.y - o.y) >= 2 OR abs(d.z - o.z) >= 2), 100) AS t FROM d JOIN o USING (vec_id, n) WHERE d.t > 0 GROUP BY ALL)")
    parts.append("f AS (SELECT o.vec_id, o.n, o.x AS ax, o.y AS ay, o.z AS az, d.x AS bx, d.y AS by_, d.z AS bz FROM o JOIN e USING (vec_id, n) JOIN d ON d.vec_id = e.vec_id AND d.n = e.n AND d.t = e.t)")
    source = "z" + str(pairs)
    parts.append(f"{source} AS (SELECT vec_id, p, i, j, k FROM ({VOX}))")
    for n in range(pairs - 1, -1, -1):
        b = "i - bx IN (0, 1) AND j - by_ IN (0, 1) AND k - bz IN (0, 1)"
        a = "i - ax IN (0, 1) AND j - ay IN (0, 1) AND k - az IN (0, 1)"
        move = ", ".join(f"CASE WHEN {b} THEN {c} - b{t} + a{t[0]} WHEN {a} THEN {c} - a{t[0]} + b{t} ELSE {c} END AS {c}" for c, t in (("i", "x"), ("j", "y_"), ("k", "z")))
        parts.append(f"z{n} AS (SELECT s.vec_id, p, {move} FROM z{n + 1} s JOIN f ON f.vec_id = s.vec_id AND f.n = {n})")
    return f"WITH {', '.join(parts)} SELECT z0.vec_id, z0.p, {rsql('embedding[CAST(i * 16 + j * 4 + k + 1 AS INT)]')} AS v FROM z0 JOIN embeddings USING (vec_id)"


piped("intensity_swap_random", lambda: Compose([Transform("Swap", {"patch_size": 2, "num_iterations": 3})]), _swap_sql(3), seed=1)


_CH = "SELECT vec_id, p // 16 AS c, p % 16 AS q, v FROM x"


@query(f"{WITH}, y AS ({_CH}) SELECT a.vec_id, a.c AS c1, b.c AS c2, {rsql('covar_samp(a.v, b.v)')} AS v FROM y a JOIN y b ON a.vec_id = b.vec_id AND a.q = b.q GROUP BY ALL")
def intensity_channel_covariance(spark, sf_dir):
    """What PCA diagonalises."""
    rows = multichannel(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), F.posexplode(st.channel_covariance(F.col("t1"))).alias("n", "v"))
    return rows.select("vec_id", F.floor(F.col("n") / 4).alias("c1"), (F.col("n") % 4).cast("bigint").alias("c2"), real(F.col("v")).alias("v"))


@query(
    f"{WITH}, y AS ({_CH}), m AS (SELECT vec_id, c, avg(v) AS m FROM y GROUP BY ALL) SELECT vec_id, q, {rsql('sum(pow(v - m, 2))')} AS energy, CAST(0 AS DOUBLE) AS mixed FROM y JOIN m USING (vec_id, c) GROUP BY vec_id, q"
)
def intensity_pca(spark, sf_dir):
    """Components are a rotation of the centred channels (energy of each voxel) and uncorrelated (largest covariance of two of them)."""
    steps = Compose([Transform("PCA", {"num_components": 4, "whiten": False, "normalize": False, "values_range": (0.0, 1.0), "clip": False})])
    out = steps(multichannel(spark, sf_dir))
    part = lambda c: F.slice(F.col("t1.data"), c * 16 + 1, 16)
    energy = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda q: sum((F.pow(F.element_at(part(c), q), 2) for c in range(1, 4)), F.pow(F.element_at(part(0), q), 2)))
    cov = F.transform(st.channel_covariance(F.col("t1")), lambda v, n: F.when(F.floor(n / 4) == n % 4, 0.0).otherwise(F.abs(v)))
    rows = out.select(F.col("subject_id").alias("vec_id"), real(F.array_max(cov)).alias("mixed"), F.posexplode(energy).alias("q", "energy"))
    return rows.select("vec_id", F.col("q").cast("bigint").alias("q"), real(F.col("energy")).alias("energy"), "mixed")


simple("intensity_labels_to_image", lambda x, s: it.labels_to_image(x, F.col("subject_id"), {0: (0.1, 0.01), 1: (0.5, 0.05), 2: (0.9, 0.1)}, seed=9), f"{WITH} SELECT vec_id, p, {rsql(f'[0.1, 0.5, 0.9][{SEG} + 1] + [0.01, 0.05, 0.1][{SEG} + 1] * ' + rng.voxel_normal_sql(9, 'tissue', 'vec_id', 'p'))} AS v FROM x", column="seg")


@query(f"{WITH} SELECT vec_id, {rsql('avg(v)')} AS mean, {rsql('stddev_samp(v)')} AS std, {rsql('min(v)')} AS low, {rsql('max(v)')} AS high, {rsql('quantile_cont(v, 0.5)')} AS median, {rsql('quantile_cont(v, 0.9)')} AS q90 FROM x GROUP BY vec_id")
def statistics_by_image(spark, sf_dir):
    stats = subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), st.statistics(F.col("t1"), [0.5, 0.9]).alias("s"))
    return stats.select("vec_id", *(real(F.col(f"s.{c}")).alias(c) for c in ("mean", "std", "low", "high")), *(real(F.get(F.col("s.quantiles"), F.lit(k))).alias(n) for k, n in enumerate(("median", "q90"))))


@query(f"{WITH} SELECT label AS cohort, count(*) AS n, {rsql('avg(v)')} AS mean, {rsql('stddev_samp(v)')} AS std FROM x GROUP BY label")
def statistics_by_cohort(spark, sf_dir):
    rows = subjects(spark, sf_dir).select("cohort", F.explode("t1.data").alias("v"))
    return rows.groupBy("cohort").agg(F.count("*").alias("n"), real(F.avg("v")).alias("mean"), real(F.stddev_samp("v")).alias("std"))


# --- labels ---
def label_sql(e: str) -> str:
    return f"{WITH} SELECT vec_id, p, CAST({e} AS BIGINT) AS v FROM (SELECT *, {SEG} AS s FROM x)"


simple("label_remap", lambda x, s: lb.remap(x, {0: 1, 1: 0, 2: 7}), label_sql("[1, 0, 7][s + 1]"), True, "seg")
simple("label_remove", lambda x, s: lb.remove(x, [1]), label_sql("CASE WHEN s = 1 THEN 0 ELSE s END"), True, "seg")
simple("label_sequential", lambda x, s: lb.sequential(lb.remap(x, {0: 5, 1: 9, 2: 7})), label_sql("dense_rank() OVER (PARTITION BY vec_id ORDER BY [5, 9, 7][s + 1]) - 1"), True, "seg")
simple("label_one_hot", lambda x, s: lb.one_hot(x, 3), f"{WITH} SELECT vec_id, n * 64 + p AS p, CAST({SEG} = n AS BIGINT) AS v FROM x, (SELECT unnest(range(3)) AS n)", True, "seg")
simple("label_one_hot_inverse", lambda x, s: lb.arg_max(lb.one_hot(x, 3)), label_sql("s"), True, "seg")


@query(f"{WITH}, y AS ({_CH}), m AS (SELECT vec_id, q, max(v) AS m FROM y GROUP BY ALL) SELECT vec_id, q AS p, min(c) AS v FROM y JOIN m USING (vec_id, q) WHERE v = m GROUP BY ALL")
def label_arg_max_channels(spark, sf_dir):
    return dump(multichannel(spark, sf_dir), lb.arg_max(F.col("t1")), True)


_LOWEST = ", ".join(f"l[{a * 16 + b * 4 + c} + p + 1]" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))


@query(
    f"{WITH}, y AS (SELECT vec_id, list({SEG} ORDER BY p) AS l FROM x GROUP BY vec_id), z AS (SELECT y.*, p, p // 16 AS i, (p // 4) % 4 AS j, p % 4 AS k FROM y, (SELECT unnest(range(64)) AS p)) "
    f"SELECT vec_id, p, CAST(CASE WHEN i IN (0, 3) OR j IN (0, 3) OR k IN (0, 3) THEN true ELSE least({_LOWEST}) < l[p + 1] END AS BIGINT) AS v FROM z"
)
def label_contour(spark, sf_dir):
    return dump(subjects(spark, sf_dir), kn.kernel(kn.contour, F.col("seg"), label=True), True)


@query(
    f"WITH RECURSIVE x AS ({VOX}), y AS (SELECT vec_id, p, i, j, k FROM x WHERE v > 0), e AS (SELECT a.vec_id, a.p AS a, b.p AS b FROM y a JOIN y b ON a.vec_id = b.vec_id AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1), "
    "r AS (SELECT vec_id, p AS a, p AS b FROM y UNION SELECT r.vec_id, r.a, e.b FROM r JOIN e ON r.vec_id = e.vec_id AND r.b = e.a), c AS (SELECT vec_id, a AS p, min(b) AS root FROM r GROUP BY ALL), "
    "n AS (SELECT vec_id, root, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, root) AS rk FROM c GROUP BY vec_id, root), big AS (SELECT vec_id, root FROM n WHERE rk = 1) "
    "SELECT x.vec_id, x.p, CAST(c.root IS NOT NULL AND c.root = big.root AS BIGINT) AS v FROM x LEFT JOIN c USING (vec_id, p) LEFT JOIN big ON x.vec_id = big.vec_id"
)
def label_keep_largest(spark, sf_dir):
    return dump(subjects(spark, sf_dir), kn.kernel(lambda v: kn.keep_largest(v, full=False), F.col("brain"), label=True), True)


# --- spatial ---
simple("spatial_crop", lambda x, s: sp.crop(x, 1), gather_sql(8, "(g // 4 + 1) * 16 + ((g // 2) % 2 + 1) * 4 + g % 2 + 1"))
_PAD = ("(g // 36 - 1)", "((g // 6) % 6 - 1)", "(g % 6 - 1)")
_IN = " AND ".join(f"{q} BETWEEN 0 AND 3" for q in _PAD)
_AT = f"(CASE WHEN {_IN} THEN {_PAD[0]} * 16 + {_PAD[1]} * 4 + {_PAD[2]} ELSE 0 END)"
for _mode, _fill in (("constant", "0.5"), ("mean", "list_avg(CAST(embedding AS DOUBLE[]))"), ("median", "list_aggregate(CAST(embedding AS DOUBLE[]), 'quantile_cont', 0.5)"), ("minimum", "CAST(list_min(embedding) AS DOUBLE)")):
    simple(f"spatial_pad_{_mode}", lambda x, s, m=_mode: sp.pad(x, 1, m, 0.5), gather_sql(216, _AT, _fill, _IN))
for _mode, _at in (("replicate", "greatest(0, least(3, {}))"), ("circular", "(({} + 4) % 4)"), ("reflect", "least(({0} + 6) % 6, 6 - ({0} + 6) % 6)")):
    simple(f"spatial_pad_{_mode}", lambda x, s, m=_mode: sp.pad(x, 1, m), gather_sql(216, f"{_at.format(_PAD[0])} * 16 + {_at.format(_PAD[1])} * 4 + {_at.format(_PAD[2])}"))
# 4 -> 3 crops one voxel in front, 4 -> 6 pads one on each side, 4 stays
simple("spatial_crop_or_pad", lambda x, s: sp.crop_or_pad(x, (4, 4, 4), (3, 6, None)), gather_sql(72, "CASE WHEN (g // 4) % 6 BETWEEN 1 AND 4 THEN (g // 24 + 1) * 16 + ((g // 4) % 6 - 1) * 4 + g % 4 ELSE 0 END", "0.0", "(g // 4) % 6 BETWEEN 1 AND 4"))
simple("spatial_ensure_multiple", lambda x, s: sp.crop_or_pad(x, (4, 4, 4), sp.multiple_shape((4, 4, 4), (3, 2, 1))), gather_sql(96, "CASE WHEN g // 16 BETWEEN 1 AND 4 THEN g - 16 ELSE 0 END", "0.0", "g // 16 BETWEEN 1 AND 4"))
simple("spatial_flip", lambda x, s: sp.flip(x, (0, 2)), gather_sql(64, "(3 - g // 16) * 16 + (g // 4) % 4 * 4 + 3 - g % 4"))
simple("spatial_transpose", lambda x, s: sp.transpose(x), gather_sql(64, "g % 4 * 16 + (g // 4) % 4 * 4 + g // 16"))
simple("spatial_reorient", lambda x, s: sp.reorient(x, "RAS", "PIR"), gather_sql(64, "g % 4 * 16 + (3 - g // 16) * 4 + 3 - (g // 4) % 4"))


@query("SELECT vec_id, 'PIR' AS codes, CAST(label AS DOUBLE) AS x, CAST(3 AS DOUBLE) AS y, CAST(3 * (1 + label % 3) AS DOUBLE) AS z FROM embeddings")
def spatial_reorient_affine(spark, sf_dir):
    a = F.col("a")
    s = subjects(spark, sf_dir).select("subject_id", sp.reorient(F.col("t1"), "RAS", "PIR")["affine"].alias("a"))
    return s.select(F.col("subject_id").alias("vec_id"), A.orientation(a).alias("codes"), *(c.alias(n) for c, n in zip(A.origin(a), "xyz", strict=True)))


@query("SELECT vec_id, CAST(label AS DOUBLE) AS x, CAST(1 + label % 3 AS DOUBLE) AS dz FROM embeddings")
def spatial_copy_affine(spark, sf_dir):
    s = subjects(spark, sf_dir).withColumn("seg", replace(F.col("seg"), affine=A.from_spacing([9, 9, 9], [0, 0, 0])))
    a = Compose([Transform("CopyAffine", {"target": "t1"}, include=["seg"])])(s).select("subject_id", F.col("seg.affine").alias("a"))
    return a.select(F.col("subject_id").alias("vec_id"), A.origin(F.col("a"))[0].alias("x"), A.spacing(F.col("a"))[2].alias("dz"))


@query("SELECT vec_id, CAST(2 AS DOUBLE) AS dx, CAST(2 * (1 + label % 3) AS DOUBLE) AS dz, CAST(label + 0.5 AS DOUBLE) AS x, CAST(0.5 * (1 + label % 3) AS DOUBLE) AS z FROM embeddings")
def spatial_to_reference(spark, sf_dir):
    small = image(1, 2, 2, 2, A.from_spacing([1, 1, 1], [0, 0, 0]), F.array(*[F.lit(0.0)] * 8))
    a = sp.to_reference_space(small, F.col("t1"))["affine"]
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), A.spacing(a)[0].alias("dx"), A.spacing(a)[2].alias("dz"), A.origin(a)[0].alias("x"), A.origin(a)[2].alias("z"))


simple("spatial_resize_nearest", lambda x, s: sp.resize(x, (2, 4, 3), "nearest"), gather_sql(24, "(g // 12) * 2 * 16 + (g // 3) % 4 * 4 + (g % 3) * 4 // 3"))
_LERP = "CAST(embedding[{a} * 16 + g % 16 + 1] AS DOUBLE) + (CAST(embedding[{b} * 16 + g % 16 + 1] AS DOUBLE) - CAST(embedding[{a} * 16 + g % 16 + 1] AS DOUBLE)) * {w}"
simple("spatial_resize_linear", lambda x, s: sp.resize(x, (6, 4, 4)), f"SELECT vec_id, g AS p, {rsql(_LERP.format(a='(g // 16 * 3 // 5)', b='least(g // 16 * 3 // 5 + 1, 3)', w='(g // 16 * 3 % 5 / 5.0)'))} AS v FROM embeddings, (SELECT unnest(range(96)) AS g)")
simple("spatial_anisotropy", lambda x, s: sp.anisotropy(x, 0, 2.0), f"SELECT vec_id, g AS p, {rsql(_LERP.format(a='(g // 48 * 2)', b='2', w='(g // 16 % 3 / 3.0)'))} AS v FROM embeddings, (SELECT unnest(range(64)) AS g)")

# linear sampling at (x0, y0, z0), 0 outside
_CORNERS = "sum((1 - abs(x0 - i)) * (1 - abs(y0 - j)) * (1 - abs(z0 - k)) * v)"
_NEAR = "abs(x0 - i) < 1 AND abs(y0 - j) < 1 AND abs(z0 - k) < 1"


@query(
    f"{WITH}, o AS (SELECT vec_id, g, (g // (2 * nk) - 0.5) * 2 + 1.5 AS x0, ((g // nk) % 2 - 0.5) * 2 + 1.5 AS y0, (g % nk - (nk - 1) / 2.0) * 2 / (1 + label % 3) + 1.5 AS z0 FROM (SELECT vec_id, label, 2 * (1 + label % 3) AS nk FROM embeddings), (SELECT unnest(range(24)) AS g) WHERE g < 4 * nk) "
    f"SELECT o.vec_id, g AS p, {rsql(f'coalesce({_CORNERS}, 0)')} AS v FROM o LEFT JOIN x ON o.vec_id = x.vec_id AND {_NEAR} GROUP BY o.vec_id, g"
)
def spatial_resample_spacing(spark, sf_dir):
    s = subjects(spark, sf_dir).withColumn("r", kn.resample(F.col("t1"), (2.0, 2.0, 2.0)))
    return dump(s, F.col("r"))


def _moved(t: tuple, order: int, degrees=(0, 0, 0)):
    return lambda v, a: kn.warp(v, a, kn.affine_matrix(v.shape[1:], a, (1, 1, 1), degrees, t), order=order)


simple("spatial_affine_linear", lambda x, s: kn.kernel(_moved((0.5, 0, 0), 1), x, x["affine"]), gather_sql(64, "g").replace("CAST(embedding[CAST(g AS INTEGER) + 1] AS DOUBLE)", "(CAST(embedding[g + 1] AS DOUBLE) + CASE WHEN g >= 16 THEN CAST(embedding[g - 15] AS DOUBLE) ELSE 0 END) / 2"))
simple("spatial_affine_nearest", lambda x, s: kn.kernel(_moved((1, 0, 0), 0), x, x["affine"]), gather_sql(64, "greatest(g - 16, 0)", "0.0", "g >= 16"))
simple("spatial_affine_rotation", lambda x, s: kn.kernel(_moved((0, 0, 0), 1, (0, 0, 90)), x, x["affine"]), gather_sql(64, "(g // 4) % 4 * 16 + (3 - g // 16) * 4 + g % 4"))


# voxel (i, j, k) of 4 lies on control point (2i, 2j, 2k) of 7; the two outer layers stay
_PUSH = [f"CASE WHEN i IN (1, 2) AND j IN (1, 2) AND k IN (1, 2) THEN ({rng.voxel_uniform_sql('4|/0', 'control', 'vec_id', f'((i * 98 + j * 14 + k * 2) * 3 + {d})')} * 2 - 1) * 1.5 ELSE 0 END" for d in range(3)]


@query(
    f"{WITH}, g AS (SELECT vec_id, p, i + {_PUSH[0]} AS x0, j + {_PUSH[1]} AS y0, k + ({_PUSH[2]}) / (1 + label % 3) AS z0 FROM x), c AS (SELECT unnest(range(8)) AS c), "
    "n AS (SELECT vec_id, p, floor(x0) + c // 4 AS i, floor(y0) + (c // 2) % 2 AS j, floor(z0) + c % 2 AS k, x0, y0, z0 FROM g, c) "
    f"SELECT n.vec_id, n.p, {rsql('sum((1 - abs(x0 - n.i)) * (1 - abs(y0 - n.j)) * (1 - abs(z0 - n.k)) * coalesce(x.v, 0))')} AS v FROM n LEFT JOIN x ON n.vec_id = x.vec_id AND n.i = x.i AND n.j = x.j AND n.k = x.k GROUP BY ALL"
)
def spatial_elastic(spark, sf_dir):
    steps = Compose([Transform("ElasticDeformation", {"num_control_points": 7, "max_displacement": 1.5, "locked_borders": 2}, include=["t1"])])
    return dump(steps(subjects(spark, sf_dir), seed=4), F.col("t1"))


@query(
    f"{WITH}, y AS (SELECT vec_id, i, j, k, p, {SEG} AS s FROM x), w AS (SELECT a.vec_id, a.p, b.s, sum(0.5) AS w FROM y a JOIN y b ON a.vec_id = b.vec_id AND b.j = a.j AND b.k = a.k AND b.i IN (a.i, a.i - 1) GROUP BY ALL) "
    "SELECT vec_id, p, CASE WHEN sum(w) > 0.5 THEN arg_max(s, w * 10 - s) ELSE 0 END::BIGINT AS v FROM w GROUP BY vec_id, p"
)
def spatial_label_partial_volume(spark, sf_dir):
    half = lambda v: kn.partial_volume(v, kn.grid(v.shape[1:]) - (0.5, 0, 0))
    return dump(subjects(spark, sf_dir), kn.kernel(half, F.col("seg"), label=True), True)


@query(f"{WITH} SELECT vec_id, {rsql('sum(v * m) / sum(m)')} AS v FROM (SELECT *, CAST(i IN (0, 3) AS INT) + CAST(j IN (0, 3) AS INT) + CAST(k IN (0, 3) AS INT) AS m FROM x) GROUP BY vec_id")
def spatial_border_mean(spark, sf_dir):
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), real(sp.border_mean(F.col("t1"))).alias("v"))


@query(
    f"{WITH}, y AS (SELECT vec_id, v, row_number() OVER w AS n, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS low, sum(v) OVER (PARTITION BY vec_id) AS al FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY v)), "
    f"z AS (SELECT vec_id, v, n, n / 64.0 * (1 - n / 64.0) * pow(low / n - (al - low) / (64 - n), 2) AS s FROM y WHERE n < 64) SELECT vec_id, {rsql('arg_max(v, (s, -n))')} AS v FROM z GROUP BY vec_id"
)
def spatial_otsu(spark, sf_dir):
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), real(it.otsu(F.col("t1"))).alias("v"))


# --- geometry and annotations ---
@query("SELECT vec_id, CAST(1 AS DOUBLE) AS dx, CAST(1 AS DOUBLE) AS dy, CAST(1 + label % 3 AS DOUBLE) AS dz, CAST(label AS DOUBLE) AS ox, 'RAS' AS codes FROM embeddings")
def geom_spacing_origin(spark, sf_dir):
    a = F.col("t1.affine")
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), *(c.alias(n) for c, n in zip(A.spacing(a), ("dx", "dy", "dz"), strict=True)), A.origin(a)[0].alias("ox"), A.orientation(a).alias("codes"))


@query(f"SELECT vec_id, {rsql('2.0 - label')} AS x, CAST(3 AS DOUBLE) AS y, {rsql('4.0 / (1 + label % 3)')} AS z FROM embeddings")
def geom_inverse_apply(spark, sf_dir):
    v = A.apply(A.inverse(F.col("t1.affine")), *map(F.lit, (2.0, 3.0, 4.0)))
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), *(real(c).alias(n) for c, n in zip(v, "xyz", strict=True)))


@query(f"SELECT vec_id, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, {rsql('CAST(label * 10 AS DOUBLE)')} AS z FROM embeddings")
def geom_euler(spark, sf_dir):
    t = F.radians(F.col("cohort") * 10.0)
    z = F.lit(0.0)
    turn = F.array(F.cos(t), -F.sin(t), z, z, F.sin(t), F.cos(t), z, z, z, z, F.lit(1.0), z, z, z, z, F.lit(1.0))
    e = [F.get(let(A.compose(turn, F.col("t1.affine")), lambda a: F.array(*A.euler(a))), F.lit(n)) for n in range(3)]
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), *(real(c).alias(n) for c, n in zip(e, "xyz", strict=True)))


def _points(spark, sf_dir) -> tuple[DataFrame, list[Column]]:
    li = table(spark, sf_dir, "lineitem")
    return li, [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]


_MAT = [2.0, 0.5, 0.0, 10.0, 0.0, 1.5, 0.0, -3.0, 0.0, 0.0, 3.0, 7.0, 0.0, 0.0, 0.0, 1.0]


@query(f"SELECT l_orderkey, l_linenumber, {rsql('2.0 * l_quantity + 0.5 * l_discount + 10')} AS x, {rsql('1.5 * l_discount - 3')} AS y, {rsql('3.0 * l_tax + 7')} AS z FROM lineitem")
def points_to_world(spark, sf_dir):
    li, p = _points(spark, sf_dir)
    w = an.to_world(p, F.array(*map(F.lit, _MAT)))
    return li.select("l_orderkey", "l_linenumber", *(real(c).alias(n) for c, n in zip(w, "xyz", strict=True)))


@query(f"SELECT l_orderkey, l_linenumber, {rsql('-l_discount')} AS x, {rsql('l_tax')} AS y, {rsql('-l_quantity')} AS z FROM lineitem")
def points_to_axes(spark, sf_dir):
    li, p = _points(spark, sf_dir)
    return li.select("l_orderkey", "l_linenumber", *(real(c).alias(n) for c, n in zip(an.to_axes(p, "RAS", "PSL"), "xyz", strict=True)))


_BOX = "SELECT l_orderkey, min(l_quantity) AS a1, min(l_discount) AS b1, min(l_tax) AS c1, max(l_quantity) AS a2, max(l_discount) AS b2, max(l_tax) AS c2 FROM lineitem GROUP BY l_orderkey"


def _boxes(spark, sf_dir) -> tuple[DataFrame, list[Column]]:
    li = table(spark, sf_dir, "lineitem")
    cols = dict(zip("abc", ("l_quantity", "l_discount", "l_tax"), strict=True))
    return li.groupBy("l_orderkey").agg(*(F.min(c).alias(f"{n}1") for n, c in cols.items()), *(F.max(c).alias(f"{n}2") for n, c in cols.items())), [F.col(f"{n}{k}") for k in (1, 2) for n in "abc"]


@query(f"SELECT l_orderkey, {', '.join(f'{rsql(f"({n}1 + {n}2) / 2")} AS {n}m, {rsql(f"{n}2 - {n}1")} AS {n}s' for n in 'abc')} FROM ({_BOX})")
def boxes_center_size(spark, sf_dir):
    df, box = _boxes(spark, sf_dir)
    c = an.corners_to_center(box)
    return df.select("l_orderkey", *(real(x).alias(f"{n}m") for x, n in zip(c[:3], "abc", strict=True)), *(real(x).alias(f"{n}s") for x, n in zip(c[3:], "abc", strict=True)))


@query(f"SELECT l_orderkey, {rsql('-b2')} AS a1, {rsql('c1')} AS b1, {rsql('-a2')} AS c1, {rsql('-b1')} AS a2, {rsql('c2')} AS b2, {rsql('-a1')} AS c2 FROM ({_BOX})")
def boxes_to_format(spark, sf_dir):
    df, box = _boxes(spark, sf_dir)
    there = an.center_to_corners(an.corners_to_center(an.corners_to_axes(box, "RAS", "PSL")))
    return df.select("l_orderkey", *(real(x).alias(n) for x, n in zip(there, ("a1", "b1", "c1", "a2", "b2", "c2"), strict=True)))


# --- patches ---
_GRID = "SELECT vec_id, o, (o // 9) AS i0, (o // 3) % 3 AS j0, o % 3 AS k0 FROM embeddings, (SELECT unnest(range(27)) AS o)"


@query(f"SELECT vec_id, o AS patch_ord, i0, j0, k0 FROM ({_GRID})")
def patch_grid_locations(spark, sf_dir):
    g = pt.grid_locations(subjects(spark, sf_dir), "t1", (2, 2, 2), (1, 1, 1))
    return g.select(F.col("subject_id").alias("vec_id"), *(F.col(c).cast("bigint").alias(c) for c in ("patch_ord", "i0", "j0", "k0")))


def _patches(spark, sf_dir):
    return pt.grid_patches(subjects(spark, sf_dir), "t1", (2, 2, 2), (1, 1, 1))


_PV = f"SELECT g.vec_id, o, q, i0 + q // 4 AS i, j0 + (q // 2) % 2 AS j, k0 + q % 2 AS k, i0, j0, k0, CAST(embedding[(i0 + q // 4) * 16 + (j0 + (q // 2) % 2) * 4 + k0 + q % 2 + 1] AS DOUBLE) AS v FROM ({_GRID}) g JOIN embeddings e USING (vec_id), (SELECT unnest(range(8)) AS q)"


@query(f"SELECT vec_id, o AS patch_ord, q, {rsql('v')} AS v FROM ({_PV})")
def patch_grid_extract(spark, sf_dir):
    rows = _patches(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), F.col("patch_ord").cast("bigint").alias("patch_ord"), F.posexplode("data").alias("q", "v"))
    return rows.select("vec_id", "patch_ord", F.col("q").cast("bigint").alias("q"), real(F.col("v")).alias("v"))


def _put(df: DataFrame) -> DataFrame:
    return df.select(F.col("subject_id").alias("vec_id"), F.col("p").cast("bigint").alias("p"), real(F.col("v")).alias("v"))


def _scaled(spark, sf_dir) -> DataFrame:
    """Patches whose values depend on the patch, so that the way they are put together shows."""
    return _patches(spark, sf_dir).withColumn("data", F.transform("data", lambda x: x + F.col("patch_ord")))


@query(f"SELECT vec_id, i * 16 + j * 4 + k AS p, {rsql('avg(v + o)')} AS v FROM ({_PV}) GROUP BY ALL")
def patch_agg_average(spark, sf_dir):
    return _put(pt.aggregate_patches(_scaled(spark, sf_dir), (4, 4, 4), (2, 2, 2)))


@query(f"SELECT vec_id, i * 16 + j * 4 + k AS p, {rsql('arg_max(v + o, o)')} AS v FROM ({_PV}) GROUP BY ALL")
def patch_agg_crop(spark, sf_dir):
    return _put(pt.aggregate_patches(_scaled(spark, sf_dir), (4, 4, 4), (2, 2, 2), "crop", (1, 1, 1)))


@query(f"SELECT vec_id, i * 16 + j * 4 + k AS p, {rsql('sum((v + o) * 0.421875) / greatest(sum(0.421875), 1)')} AS v FROM ({_PV}) GROUP BY ALL")
def patch_agg_hann(spark, sf_dir):
    # the window of 2 voxels is 0.75 on each axis
    return _put(pt.aggregate_patches(_scaled(spark, sf_dir), (4, 4, 4), (2, 2, 2), "hann"))


_UKEY = "concat_ws(':', vec_id, n)"
_DRAW = "SELECT vec_id, embedding, n FROM embeddings, (SELECT unnest(range(3)) AS n)"


@query(f"SELECT vec_id, n AS patch_ord, {', '.join(f'CAST(floor({rng.uniform_sql(2, f"patch.{a}", _UKEY)} * 3) AS BIGINT) AS {o}' for a, o in zip(('si', 'sj', 'sk'), ('i0', 'j0', 'k0'), strict=True))} FROM ({_DRAW})")
def patch_uniform(spark, sf_dir):
    return _places(pt.uniform_patches(subjects(spark, sf_dir), "t1", (2, 2, 2), 3, seed=2))


def _places(df: DataFrame) -> DataFrame:
    return df.select(F.col("subject_id").alias("vec_id"), *(F.col(c).cast("bigint").alias(c) for c in ("patch_ord", "i0", "j0", "k0")))


def _weighted_sql(weight: str) -> str:
    return (
        f"{WITH}, w AS (SELECT *, CASE WHEN i BETWEEN 1 AND 2 AND j BETWEEN 1 AND 2 AND k BETWEEN 1 AND 2 THEN {weight} ELSE 0 END AS w FROM x), c AS (SELECT vec_id, p, sum(w) OVER (PARTITION BY vec_id ORDER BY p) AS s, sum(w) OVER (PARTITION BY vec_id) AS t FROM w), "
        f"d AS (SELECT vec_id, n, {rng.uniform_sql(2, 'patch.w', _UKEY)} AS u FROM ({_DRAW})), q AS (SELECT d.vec_id, n, count(*) AS p FROM d JOIN c USING (vec_id) WHERE s <= u * t GROUP BY ALL) "
        "SELECT vec_id, n AS patch_ord, p // 16 - 1 AS i0, (p // 4) % 4 - 1 AS j0, p % 4 - 1 AS k0 FROM q"
    )


@query(_weighted_sql("abs(v) + 1"))
def patch_weighted(spark, sf_dir):
    s = subjects(spark, sf_dir).withColumn("w", replace(F.col("t1"), data=F.transform("t1.data", lambda x: F.abs(x) + 1)))
    return _places(pt.weighted_patches(s, "t1", "w", (2, 2, 2), 3, seed=2))


@query(_weighted_sql(f"[1, 2, 4][{SEG} + 1]"))
def patch_label_sampler(spark, sf_dir):
    s = subjects(spark, sf_dir).withColumn("w", lb.remap(F.col("seg"), {0: 1, 1: 2, 2: 4}))
    return _places(pt.weighted_patches(s, "t1", "w", (2, 2, 2), 3, seed=2))


@query(
    f"WITH g AS ({_GRID}), f AS (SELECT vec_id, o, vec_id // 1 AS r FROM g WHERE o < 5), k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings) "
    "SELECT vec_id, o AS patch_ord, k.r // 8 AS buffer, row_number() OVER (PARTITION BY k.r // 8 ORDER BY md5(concat_ws('|', '6', CAST(vec_id AS VARCHAR), CAST(o AS VARCHAR))), vec_id, o) - 1 AS place FROM f JOIN k USING (vec_id)"
)
def stream_queue_epoch(spark, sf_dir):
    q = pt.queue(pt.grid_locations(subjects(spark, sf_dir), "t1", (2, 2, 2), (1, 1, 1)), per_subject=5, buffer_subjects=8, seed=6)
    return q.select(F.col("subject_id").alias("vec_id"), F.col("patch_ord").cast("bigint").alias("patch_ord"), F.col("buffer").cast("bigint").alias("buffer"), "place")


_ORDER = "CAST('0x' || substr(md5(concat_ws('|', '6', 'subject', CAST(vec_id AS VARCHAR))), 1, 8) AS BIGINT)"


@query(
    f"WITH g AS ({_GRID}), k AS (SELECT vec_id, row_number() OVER (ORDER BY {_ORDER}, vec_id) - 1 AS r FROM embeddings) "
    "SELECT vec_id, o AS patch_ord, k.r // 4 AS buffer, row_number() OVER (PARTITION BY k.r // 4 ORDER BY md5(concat_ws('|', '6', CAST(vec_id AS VARCHAR), CAST(o AS VARCHAR))), vec_id, o) - 1 AS place FROM g JOIN k USING (vec_id) WHERE o < 5"
)
def stream_queue_shuffled(spark, sf_dir):
    """Subjects in random order, buffers of 20 patches or more."""
    q = pt.queue(pt.grid_locations(subjects(spark, sf_dir), "t1", (2, 2, 2), (1, 1, 1)), per_subject=5, max_length=17, shuffle_subjects=True, seed=6)
    return q.select(F.col("subject_id").alias("vec_id"), F.col("patch_ord").cast("bigint").alias("patch_ord"), F.col("buffer").cast("bigint").alias("buffer"), "place")


@query(f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {rsql('sum(value)')} AS total FROM events GROUP BY ALL")
def stream_event_windows(spark, sf_dir):
    """The events as a stream of files, counted by window in micro-batches."""
    folder, kind = be.scratch(spark, "windows"), table(spark, sf_dir, "events").schema
    # as a pattern, for a stream takes a folder or a pattern but no single file
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    event_counts(stream, folder).awaitTermination()
    w = spark.read.parquet(f"{folder}/counts")
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", real(F.col("total")).alias("total"))


# --- composition, provenance, sets, joins ---
@query(f"{WITH}, s AS (SELECT vec_id, avg(v) AS m, stddev_samp(v) AS d FROM x WHERE v > 0 GROUP BY vec_id) SELECT vec_id, (3 - i) * 16 + j * 4 + k AS p, {rsql('greatest(-2, least(2, (v - m) / d))')} AS v FROM x JOIN s USING (vec_id)")
def compose_pipeline(spark, sf_dir):
    """The flagship: masked standardization, clamping and a flip as one plan without a shuffle."""
    steps = Compose([Transform("Standardize", {"mask": "brain"}), Transform("Clamp", {"out_min": -2.0, "out_max": 2.0}), Transform("Flip", {"axes": 0}, include=["t1"])])
    return dump(steps(subjects(spark, sf_dir)), F.col("t1"))


_ONE = rng.uniform_sql(8, "/0.one", "vec_id")


@query(voxel_sql(f"CASE WHEN {_ONE} < 0.25 THEN greatest(v, 0.0) ELSE least(v, 0.0) END"))
def compose_one_of(spark, sf_dir):
    steps = Compose([OneOf([Transform("Clamp", {"out_min": 0.0}), Transform("Clamp", {"out_max": 0.0})], [1.0, 3.0])])
    return dump(steps(subjects(spark, sf_dir), seed=8), F.col("t1"))


_O0, _O1 = rng.uniform_sql(8, "/0.o0", "vec_id"), rng.uniform_sql(8, "/0.o1", "vec_id")
_TWO = f"floor({rng.uniform_sql(8, '/0.n', 'vec_id')} * 2) + 1 >= 2"


@query(voxel_sql(f"CASE WHEN {_O0} < {_O1} THEN CASE WHEN {_TWO} THEN least(greatest(v, 0.0), -0.05) ELSE greatest(v, 0.0) END ELSE CASE WHEN {_TWO} THEN greatest(least(v, -0.05), 0.0) ELSE least(v, -0.05) END END"))
def compose_some_of(spark, sf_dir):
    steps = Compose([SomeOf([Transform("Clamp", {"out_min": 0.0}), Transform("Clamp", {"out_max": -0.05})], 1, 2)])
    return dump(steps(subjects(spark, sf_dir), seed=8), F.col("t1"))


@query(voxel_sql("v"))
def inverse_replay(spark, sf_dir):
    """Random gamma and flips, undone from every row's own history."""
    steps = Compose([Transform("Gamma", {"log_gamma": [-0.3, 0.3]}), Transform("Flip", {"axes": 1}, p=0.5), OneOf([Transform("Flip", {"axes": 2}), Transform("Transpose")])])
    s = subjects(spark, sf_dir).select("subject_id", "t1")
    return dump(invert_history(steps(s, seed=4)), F.col("t1"))


@query(voxel_sql("v"))
def inverse_pipeline(spark, sf_dir):
    steps = Compose([Transform("Gamma", {"log_gamma": [-0.3, 0.3]}), Transform("Pad", {"padding": 1}), Transform("Flip", {"axes": [0, 2], "flip_probability": 0.5}), Transform("Transpose")])
    s = subjects(spark, sf_dir).select("subject_id", "t1")
    return dump(steps.inverse(steps(s, seed=4)), F.col("t1"))


for _name, _steps, _column in (
    ("inverse_standardize", lambda: Compose([Transform("Standardize", {"mask": "brain"})]), "t1"),
    ("inverse_normalize", lambda: Compose([Transform("Normalize", {"out_min": [-2.0, -1.0], "out_max": [1.0, 2.0]})]), "t1"),
    ("inverse_bias_field", lambda: Compose([Transform("BiasField", {"std": [0.1, 0.5]}, p=0.7)]), "t1"),
    ("inverse_reorient", lambda: Compose([Transform("Reorient", {"orientation": "PIL"}), Transform("Flip", {"axes": "Left"})]), "t1"),
    ("inverse_ensure_multiple", lambda: Compose([Transform("EnsureShapeMultiple", {"target_multiple": 3})]), "t1"),
    ("replay_flip_axes", lambda: Compose([Transform("Flip", {"axes": [0, 2]})]), "t1"),
    ("replay_flip_coin", lambda: Compose([Transform("Flip", {"axes": [0, 1, 2], "flip_probability": 0.5})]), "t1"),
    ("replay_one_of", lambda: Compose([OneOf([Transform("Transpose"), Transform("Clamp", {"out_max": 9.0}), Transform("Flip", {"axes": 1})], [1, 2, 3])]), "t1"),
):
    piped(_name, _steps, voxel_sql("v"), seed=6, column=_column, back=True)
for _name, _steps in (("inverse_one_hot", lambda: Compose([Transform("OneHot", {"num_classes": 3}, include=["seg"])])), ("inverse_sequential", lambda: Compose([Transform("RemapLabels", {"remapping": {1: 7, 2: 4}}, include=["seg"]), Transform("SequentialLabels")]))):
    piped(_name, _steps, label_sql("s"), seed=6, whole=True, column="seg", back=True)

# a shift by (0.5 mm, 0, 0) and back, both linear
piped("inverse_affine", lambda: Compose([Transform("Affine", {"translation": (0.5, 0.0, 0.0)}, include=["t1"])]), f"SELECT vec_id, g AS p, {rsql('(CASE WHEN g >= 16 THEN e[g - 15] ELSE 0 END + e[g + 1]) / 4.0 + CASE WHEN g < 48 THEN (e[g + 1] + e[g + 17]) / 4.0 ELSE 0 END')} AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), (SELECT unnest(range(64)) AS g)", back=True)


# --- the registry's transforms as pipelines ---
piped("compose_blur", lambda: Compose([Transform("Blur", {"std": 0.8}, include=["t1"])]), (
    f"{WITH}, w AS (SELECT * FROM {_blur_weights(0.8)} t(o, w)), a AS (SELECT x.vec_id, x.p, x.label, sum(w.w * y.v) AS v FROM x, w, x y WHERE y.vec_id = x.vec_id AND y.i = greatest(0, least(3, x.i + o)) AND y.j = x.j AND y.k = x.k GROUP BY ALL), "
    f"b AS (SELECT a.vec_id, a.p, a.label, sum(w.w * y.v) AS v FROM a, w, a y WHERE y.vec_id = a.vec_id AND y.p = a.p // 16 * 16 + greatest(0, least(3, (a.p // 4) % 4 + o)) * 4 + a.p % 4 GROUP BY ALL), "
    f"z AS (SELECT 0 AS l, * FROM {_blur_weights(0.8)} t(o, w) UNION ALL SELECT 1, * FROM {_blur_weights(0.8 / 2)} t(o, w) UNION ALL SELECT 2, * FROM {_blur_weights(0.8 / 3)} t(o, w)), "
    f"c AS (SELECT b.vec_id, b.p, sum(z.w * y.v) AS v FROM b, z, b y WHERE z.l = b.label % 3 AND y.vec_id = b.vec_id AND y.p = b.p // 4 * 4 + greatest(0, least(3, b.p % 4 + o)) GROUP BY ALL) SELECT vec_id, p, {rsql('v')} AS v FROM c"
))
piped("compose_affine", lambda: Compose([Transform("Affine", {"degrees": (0, 0, 90)}, include=["t1"])]), gather_sql(64, "(g // 4) % 4 * 16 + (3 - g // 16) * 4 + g % 4"))
_SHIFT = f"(floor(3 * {rng.uniform_sql(2, '/0.translation.0', 'vec_id')}) - 1)"
piped("compose_affine_random", lambda: Compose([Transform("Affine", {"translation": ({"choice": [-1, 0, 1]}, 0, 0), "image_interpolation": "nearest"}, include=["t1"])]), gather_sql(64, f"greatest(0, least(63, g - 16 * {_SHIFT}))", "0.0", f"g // 16 - {_SHIFT} BETWEEN 0 AND 3"), seed=2)
piped("compose_affine_fill_minimum", lambda: Compose([Transform("Affine", {"translation": (1, 0, 0), "image_interpolation": "nearest", "default_pad_value": "minimum"}, include=["t1"])]), gather_sql(64, "greatest(g - 16, 0)", "CAST(list_min(embedding) AS DOUBLE)", "g >= 16"))
piped("compose_affine_cubic", lambda: Compose([Transform("Affine", {"translation": (1, 0, 0), "image_interpolation": "cubic"}, include=["t1"])]), gather_sql(64, "greatest(g - 16, 0)", "0.0", "g >= 16"))
piped("compose_ghosting", lambda: Compose([Transform("Ghosting", {"num_ghosts": 2, "axes": 0, "intensity": 0.5})]), _dft("i", [0.5, 1.0, 0.5, 1.0]))
piped("compose_hist_standardize", lambda: Compose([Transform("HistogramStandardization", {"landmarks": _MARKS})]), ORACLES["intensity_hist_standardize"])
piped("compose_normalize_masked", lambda: Compose([Transform("Normalize", {"percentile_low": 5.0, "percentile_high": 95.0, "mask": "brain"})]), ORACLES["intensity_normalize_masked"])
piped("compose_one_hot", lambda: Compose([Transform("OneHot", {"num_classes": 3}, include=["seg"])]), ORACLES["label_one_hot"], whole=True, column="seg")
piped("compose_contour", lambda: Compose([Transform("Contour", include=["seg"])]), ORACLES["label_contour"], whole=True, column="seg")
piped("compose_keep_largest", lambda: Compose([Transform("KeepLargestComponent", {"fully_connected": False}, include=["brain"])]), ORACLES["label_keep_largest"], whole=True, column="brain")
piped("compose_crop_or_pad", lambda: Compose([Transform("CropOrPad", {"target_shape": (3, 6, None)})]), ORACLES["spatial_crop_or_pad"])
piped("compose_crop_or_pad_mm", lambda: Compose([Transform("CropOrPad", {"target_shape": (0.3, None, None), "units": "cm"})]), gather_sql(48, "g + 16"))
piped("compose_ensure_multiple", lambda: Compose([Transform("EnsureShapeMultiple", {"target_multiple": (3, 2, 1)})]), ORACLES["spatial_ensure_multiple"])
piped("compose_reorient", lambda: Compose([Transform("Reorient", {"orientation": "PIR"})]), ORACLES["spatial_reorient"])
piped("compose_resize", lambda: Compose([Transform("Resize", {"target_shape": (6, 4, 4)})]), ORACLES["spatial_resize_linear"])
piped("compose_anisotropy", lambda: Compose([Transform("Anisotropy", {"axes": 0, "downsampling": 2.0})]), ORACLES["spatial_anisotropy"])
piped("compose_resample", lambda: Compose([Transform("Resample", {"target": 2.0}, include=["t1"])]), ORACLES["spatial_resample_spacing"])
piped("compose_labels_partial_volume", lambda: Compose([Transform("Affine", {"translation": (0.5, 0, 0), "label_interpolation": "one_hot"}, include=["seg"])]), ORACLES["spatial_label_partial_volume"], whole=True, column="seg")
piped("compose_lambda", lambda: Compose([Transform("Lambda", {"function": lambda v: v * 2 + 1, "types_to_apply": "scalar"})]), ORACLES["udf_lambda"] if "udf_lambda" in ORACLES else voxel_sql("v * 2 + 1"))
piped("udf_multi_adapter", lambda: Compose([Transform("ArrayAdapter", {"function": lambda d: {"t1": d["t1"] * d["brain"]}}, include=["t1", "brain"])]), voxel_sql("CASE WHEN v > 0 THEN v ELSE 0 END"))
_TISSUE = rng.voxel_normal_sql("9|/0", "tissue.noise", "vec_id", "p")
piped("compose_labels_to_image", lambda: Compose([Transform("LabelsToImage", {"label_key": "brain", "mean": [0.1, 0.9], "std": [0.01, 0.1]})]), f"{WITH}, l AS (SELECT vec_id, min(CAST(v > 0 AS INT)) AS low FROM x GROUP BY vec_id) SELECT vec_id, p, {rsql(f'[0.1, 0.9][CAST(v > 0 AS INT) - low + 1] + [0.01, 0.1][CAST(v > 0 AS INT) - low + 1] * {_TISSUE}')} AS v FROM x JOIN l USING (vec_id)", seed=9, column="image_from_labels")
piped("compose_transform_operators", lambda: Transform("Clamp", {"out_min": 0.0}) + Transform("Flip", {"axes": 0}, include=["t1"]), gather_sql(64, "(3 - g // 16) * 16 + g % 16").replace("CAST(embedding[", "greatest(0, embedding[").replace("] AS DOUBLE)", "])"))
_HALF = f"{rng.uniform_sql(3, '/0.one', 'vec_id')} < 0.5"
piped("compose_or", lambda: Compose([Transform("Clamp", {"out_min": 0.0}) | Transform("Clamp", {"out_max": 0.0})]), voxel_sql(f"CASE WHEN {_HALF} THEN greatest(v, 0.0) ELSE least(v, 0.0) END"), seed=3)
_AGAIN = [rng.uniform_sql(8, f"/0/{n}.one", "vec_id") + " < 0.5" for n in range(2)]
piped("compose_some_of_replacement", lambda: Compose([SomeOf([Transform("Lambda", {"function": lambda v: v * 2}, include=["t1"]), Transform("Lambda", {"function": lambda v: v + 1}, include=["t1"])], 2, 2, True)]), voxel_sql(f"CASE WHEN {_AGAIN[0]} THEN CASE WHEN {_AGAIN[1]} THEN v * 4 ELSE v * 2 + 1 END ELSE CASE WHEN {_AGAIN[1]} THEN (v + 1) * 2 ELSE v + 2 END END"), seed=8)


@query(f"SELECT vec_id, CASE WHEN {rng.uniform_sql(4, '/1.p', 'vec_id')} < 0.5 THEN 'Clamp>Flip' ELSE 'Clamp' END AS names, 1 + CAST({rng.uniform_sql(4, '/1.p', 'vec_id')} < 0.5 AS BIGINT) AS n FROM embeddings")
def history_trace(spark, sf_dir):
    steps = Compose([Transform("Clamp", {"out_min": 0.0}), Transform("Flip", {"axes": 1}, p=0.5)])
    h = steps(subjects(spark, sf_dir), seed=4)
    return h.select(F.col("subject_id").alias("vec_id"), F.array_join(F.transform("history", lambda r: r["name"]), ">").alias("names"), F.size("history").cast("bigint").alias("n"))


_RANK = "SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings"


@query(f"SELECT r // 16 AS batch, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id, {rsql('sum(list_sum(CAST(embedding AS DOUBLE[])))')} AS total FROM ({_RANK}) GROUP BY r // 16")
def batch_stack(spark, sf_dir):
    b = bt.stack(subjects(spark, sf_dir), ["t1", "seg"], 16)
    total = F.aggregate(F.transform("t1", lambda x: F.aggregate(x["data"], F.lit(0.0), lambda s, v: s + v)), F.lit(0.0), lambda s, v: s + v)
    return b.select("batch", "n", F.array_min("keys").alias("first_id"), F.array_max("keys").alias("last_id"), real(total).alias("total"))


@query(f"SELECT vec_id, r // 16 AS batch, r % 16 AS place, p, {rsql('CAST(embedding[p + 1] AS DOUBLE)')} AS v FROM ({_RANK}), (SELECT unnest(range(64)) AS p)")
def batch_unbatch(spark, sf_dir):
    """Batches of 16 subjects, taken apart again."""
    back = bt.unstack(bt.stack(subjects(spark, sf_dir), ["t1", "seg"], 16), ["t1", "seg"])
    rows = back.select(F.col("subject_id").alias("vec_id"), "batch", F.col("place").cast("bigint").alias("place"), F.posexplode("t1.data").alias("p", "v"))
    return rows.select("vec_id", "batch", "place", F.col("p").cast("bigint").alias("p"), real(F.col("v")).alias("v"))


@query("SELECT vec_id, true AS shapes, label % 3 = 0 AS spacings, label = 0 AS origins FROM embeddings")
def subject_consistency_check(spark, sf_dir):
    """Whether two images of a subject have one shape, spacing and origin."""
    s = subjects(spark, sf_dir).withColumn("seg", replace(F.col("seg"), affine=A.from_spacing([1, 1, 1], [0, 0, 0])))
    return s.select(F.col("subject_id").alias("vec_id"), *(bt.consistent(["t1", "seg"], k).alias(f"{k}s") for k in ("shape", "spacing", "origin")))


@query("SELECT a.o_orderkey, a.o_totalprice AS t1, c.c_acctbal AS t2 FROM orders a JOIN customer c ON a.o_custkey = c.c_custkey")
def source_join_modalities(spark, sf_dir):
    """Subjects that are present in both modalities."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("o_totalprice").alias("t1"), F.col("c_acctbal").alias("t2"))


@query("WITH a AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, label FROM embeddings), b AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, c_nationkey FROM customer) SELECT vec_id, c_custkey FROM a JOIN b ON a.n = b.n AND a.label = b.c_nationkey")
def source_zip_positional(spark, sf_dir):
    """Images and labels paired by sorted position inside a group."""
    from pyspark.sql import Window

    a = subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), "cohort", F.row_number().over(Window.partitionBy("cohort").orderBy("subject_id")).alias("n"))
    b = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cohort"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("n"))
    return a.join(b, ["cohort", "n"]).select("vec_id", "c_custkey")


@query(voxel_sql("v * 2 + 1"))
def udf_lambda(spark, sf_dir):
    """A user function of volumes, in Arrow batches."""
    return dump(subjects(spark, sf_dir), kn.kernel(lambda v: v * 2 + 1, F.col("t1")))


@query(f"{WITH} SELECT vec_id, p, {rsql('v - avg(v) OVER (PARTITION BY vec_id)')} AS v FROM x")
def udf_array_adapter(spark, sf_dir):
    """A foreign transform that knows only arrays."""

    class Center:
        def __call__(self, array):
            return array - array.mean()

    foreign = Center()
    return dump(subjects(spark, sf_dir), kn.kernel(lambda v: foreign(v), F.col("t1")))


# --- files ---
def _saved(spark, sf_dir, suffix: str = ".nii") -> str:
    """The subjects' first images as files of a new shared folder."""
    folder = be.scratch(spark, "volumes")
    be.save_files(subjects(spark, sf_dir), "t1", "subject_id", folder, suffix).count()
    return folder


def _by_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("subject_id", F.regexp_extract("path", r"(\d+)\.[^/]*$", 1).cast("bigint"))


def _file_query(name: str, suffix: str, region: str | None, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: dump(_by_file(be.scan(spark, _saved(spark, sf_dir, suffix), region=region)), F.col("image"))
    ORACLES[name] = sql


_REGION = gather_sql(8, "(g // 4 + 1) * 16 + (g // 2) % 2 * 4 + g % 2 + 2")
_file_query("source_nifti_scan", ".nii", None, voxel_sql("v"))
_file_query("source_nifti_gz_region", ".nii.gz", ":, 1:3, 0:2, 2:", _REGION)
_file_query("source_nifti_region", ".nii", ":, 1:3, :2, 2:4", _REGION)
_file_query("source_nifti_steps", ".nii", "0, ::2, -1", gather_sql(8, "g // 4 * 32 + 12 + g % 4"))
_file_query("source_nrrd_scan", ".nrrd", None, voxel_sql("v"))


@query(ORACLES["scan_header"])
def source_nifti_headers(spark, sf_dir):
    h = _by_file(be.scan(spark, _saved(spark, sf_dir), header=True))
    return h.select(F.col("subject_id").alias("vec_id"), *(F.col(n).cast("bigint").alias(n) for n in ("c", "si", "sj", "sk")), A.origin(F.col("affine"))[0].alias("ox"), A.spacing(F.col("affine"))[2].alias("dz"))


@query(f"{WITH} SELECT vec_id, p, {rsql('v')} AS v, {rsql('v * 2')} AS w FROM x WHERE vec_id % 2 = 0")
def source_modalities(spark, sf_dir):
    """Folders t1 and t2 of files; subjects that both hold."""
    folder, s = be.scratch(spark, "modalities"), subjects(spark, sf_dir)
    for name, rows in (("t1", s), ("t2", s.where("subject_id % 2 = 0").withColumn("t1", replace(F.col("t1"), data=F.transform("t1.data", lambda x: x * 2))))):
        be.save_files(rows.withColumn("file", F.concat("subject_id", F.lit(f"-{name}"))), "t1", "file", f"{folder}/{name}").count()
    both = be.scan_modalities(spark, folder, ["t1", "t2"])
    rows = both.select(F.col("subject_id").cast("bigint").alias("vec_id"), F.posexplode(F.arrays_zip(F.col("t1.data").alias("v"), F.col("t2.data").alias("w"))).alias("p", "e"))
    return rows.select("vec_id", F.col("p").cast("bigint").alias("p"), real(F.col("e.v")).alias("v"), real(F.col("e.w")).alias("w"))


@query(gather_sql(18, "(g // 6 + 1) * 16 + (g // 2 % 3) * 4 + g % 2 + 1"))
def source_bricks_region(spark, sf_dir):
    """Volumes cut into bricks of 2 x 3 x 4 in Parquet; a region is read from the bricks that it meets."""
    path = be.scratch(spark, "bricks")
    be.bricks(subjects(spark, sf_dir), "t1", "subject_id", (2, 3, 4)).write.parquet(path)
    rows = be.read_region(spark.read.parquet(path), (2, 3, 4), "1:4, 0:3, 1:3")
    return dump(rows.withColumnRenamed("key", "subject_id"), F.col("image"))


piped("slice_index", lambda: Compose([Transform("Slice", {"index": "0, 1:3, ..., -1"}, include=["t1"])]), gather_sql(8, "(g // 4 + 1) * 16 + g % 4 * 4 + 3"))
piped("slice_subject", lambda: Compose([Transform("Slice", {"index": "1:3, ::2", "spatial": True})]), f"{WITH} SELECT vec_id, (i - 1) * 8 + j // 2 * 4 + k AS p, CAST({SEG} AS BIGINT) AS v FROM x WHERE i IN (1, 2) AND j % 2 = 0", whole=True, column="seg")


@query("SELECT vec_id, CAST(label AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(1 + label % 3 AS DOUBLE) AS z, CAST(2 AS DOUBLE) AS dy FROM embeddings")
def slice_steps_affine(spark, sf_dir):
    out = Compose([Transform("Slice", {"index": ":, :, ::2, 1:"}, include=["t1"])])(subjects(spark, sf_dir)).select("subject_id", F.col("t1.affine").alias("a"))
    return out.select(F.col("subject_id").alias("vec_id"), *(c.alias(n) for c, n in zip(A.origin(F.col("a")), "xyz", strict=True)), A.spacing(F.col("a"))[1].alias("dy"))


# --- annotations between voxel and anatomical axes: the affine is diag(1, 1, dz) with its origin at (label, 0, 0) ---
@query(f"SELECT vec_id, {rsql('-(3.0 + label)')} AS x, {rsql('2.0 * (1 + label % 3)')} AS y, {rsql('1.0')} AS z FROM embeddings")
def points_voxel_to_anatomical(spark, sf_dir):
    # k, i, j of 2, 3, 1
    p = an.to_axes([F.lit(2.0), F.lit(3.0), F.lit(1.0)], "KIJ", "LSA", affine=F.col("t1.affine"))
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), *(real(c).alias(n) for c, n in zip(p, "xyz", strict=True)))


@query(f"SELECT vec_id, {rsql('5.0')} AS x, {rsql('-4.0 - label')} AS y, {rsql('6.0 / (1 + label % 3)')} AS z FROM embeddings")
def points_anatomical_to_voxel(spark, sf_dir):
    p = an.to_axes([F.lit(4.0), F.lit(-5.0), F.lit(6.0)], "LPS", "JIK", affine=F.col("t1.affine"))
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), *(real(c).alias(n) for c, n in zip(p, "xyz", strict=True)))


@query(f"SELECT vec_id, {rsql('-1.5 - label')} AS x, {rsql('1.0')} AS y, {rsql('1.5 * (1 + label % 3)')} AS z, {rsql('3.0')} AS a, {rsql('2.0')} AS b, {rsql('1.0 + label % 3')} AS c FROM embeddings")
def boxes_cross_type(spark, sf_dir):
    box = [F.lit(float(v)) for v in (0, 0, 1, 3, 2, 2)]
    there = an.to_format(box, ("IJK", "corners"), ("LAS", "center_size"), F.col("t1.affine"))
    return subjects(spark, sf_dir).select(F.col("subject_id").alias("vec_id"), *(real(c).alias(n) for c, n in zip(there, "xyzabc", strict=True)))


@query(f"SELECT vec_id, i * 16 + j * 4 + k AS p, {rsql('avg(v + o)')} AS v, {rsql('avg(2 * v)')} AS w FROM ({_PV}) GROUP BY ALL")
def patch_agg_two_outputs(spark, sf_dir):
    """Two outputs of each patch put together at once."""
    two = _scaled(spark, sf_dir).withColumn("other", F.transform("data", lambda x: (x - F.col("patch_ord")) * 2))
    whole = pt.assemble(two, (4, 4, 4), (2, 2, 2), data=("data", "other"))
    rows = whole.select(F.col("subject_id").alias("vec_id"), F.posexplode(F.arrays_zip(F.col("data").alias("v"), F.col("other").alias("w"))).alias("p", "e"))
    return rows.select("vec_id", F.col("p").cast("bigint").alias("p"), real(F.col("e.v")).alias("v"), real(F.col("e.w")).alias("w"))


# rings about the centre voxel 10; the radius counts as -10 both in the phase and in the falling factor
_RING = "sqrt(pow(i - 10, 2) + pow(j - 10, 2) + pow(k - 10, 2))"
_TANH = "((exp(2 * t) - 1) / (exp(2 * t) + 1))"


@query(
    f"WITH g AS (SELECT g // 441 AS i, (g // 21) % 21 AS j, g % 21 AS k FROM (SELECT unnest(range(9261)) AS g)), r AS (SELECT *, {_RING} AS r, (-10.0 - {_RING}) / -1.0 AS t FROM g) "
    f"SELECT i, j, k, {rsql(f'sin(0.8 * pi() * r * r / -20.0) * (0.5 * {_TANH} + 0.5)')} AS v FROM r"
)
def source_zone_plate(spark, sf_dir):
    return zone_plate(spark, 21).select("i", "j", "k", real(F.col("v")).alias("v"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
