"""Intensity operators on image structs: column in, column out, evaluated inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rng
from ..functions.image import bound, let, mean, quantile, quantiles, replace, stddev

# The quantiles of histogram landmarks.
QUANTILES = (0.01, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.99)


def _masked(img: Column, mask: Column | None) -> Column:
    """The values where the mask is not 0; all of them if there are none."""
    if mask is None:
        return img["data"]
    kept = F.filter(F.zip_with(img["data"], mask["data"], lambda x, m: F.when(m != 0, x)), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(img["data"])


@bound
def clamp(img: Column, out_min: float | None = None, out_max: float | None = None) -> Column:
    if out_min is not None and out_max is not None and out_min > out_max:
        raise ValueError("out_min is above out_max")

    def f(x: Column) -> Column:
        x = x if out_min is None else F.greatest(x, F.lit(float(out_min)))
        return x if out_max is None else F.least(x, F.lit(float(out_max)))

    return replace(img, data=F.transform(img["data"], f))


@bound
def gamma(img: Column, log_gamma: float | Column) -> Column:
    power = F.exp(log_gamma if isinstance(log_gamma, Column) else F.lit(float(log_gamma)))
    return replace(img, data=F.transform(img["data"], lambda x: F.signum(x) * F.pow(F.abs(x), power)))


@bound
def normalize(img: Column, out_min=-1.0, out_max=1.0, *, in_range: tuple[float, float] | None = None, percentiles=(0.0, 100.0), mask: Column | None = None) -> Column:
    """Clamps to the input range (given, or percentiles of the masked voxels) and maps it to the output range; a range of 0 changes nothing."""
    if in_range:
        pair = F.array(*map(F.lit, map(float, in_range)))
    else:
        pair = quantiles(_masked(img, mask), [p / 100 for p in percentiles])
    lo_hi = lambda r: (F.get(r, F.lit(0)), F.get(r, F.lit(1)))

    def scaled(r: Column) -> Column:
        lo, hi = lo_hi(r)
        width = F.nullif(hi - lo, F.lit(0.0))
        return F.transform(img["data"], lambda x: F.coalesce((F.least(F.greatest(x, lo), hi) - lo) / width * (out_max - out_min) + out_min, x))

    return replace(img, data=let(pair, scaled))


@bound
def standardize(img: Column, mask: Column | None = None) -> Column:
    """Zero mean and unit (unbiased) deviation of the masked voxels; a constant image raises."""

    def scaled(v: Column) -> Column:
        def by(m: Column) -> Column:
            s = stddev(v, m)
            checked = F.when(s > 0, s).otherwise(F.raise_error(F.lit("standard deviation is 0")).cast("double"))
            return let(checked, lambda d: F.transform(img["data"], lambda x: (x - m) / d))

        return let(mean(v), by)

    return replace(img, data=let(_masked(img, mask), scaled))


@bound
def apply_mask(img: Column, mask: Column, *, labels: list[int] | None = None, outside: float = 0.0) -> Column:
    inside = (lambda m: m.isin(labels)) if labels else (lambda m: m != 0)
    return replace(img, data=F.zip_with(img["data"], mask["data"], lambda x, m: F.when(inside(m), x).otherwise(F.lit(float(outside)))))


@bound
def noise(img: Column, key: Column, *, mean: float = 0.0, std: float | Column = 0.25, rician: bool = False, seed: int = 0) -> Column:
    """Seeded Gaussian or Rician noise; key names the row, each voxel has its own counter."""
    streams = ["noise1", "noise2"][: 1 + rician]
    starts = F.array(*(rng.base(seed, f"{s}.{k}", key) for s in streams for k in "uv"))

    def noisy(b: Column) -> Column:
        n = lambda k, p: rng.voxel_normal(F.get(b, F.lit(2 * k)), F.get(b, F.lit(2 * k + 1)), p) * std + mean

        def one(x: Column, p: Column) -> Column:
            return F.sqrt(F.pow(x + n(0, p), 2) + F.pow(n(1, p), 2)) if rician else x + n(0, p)

        return F.transform(img["data"], one)

    return replace(img, data=let(starts, noisy))


def landmarks(images: DataFrame, column: str, *, quantile_list=QUANTILES, cutoff=(0.01, 0.99)) -> DataFrame:
    """(quantile, value): each image's quantiles mapped so that the cutoffs lie at 0 and 100, averaged over images.

    Quantiles are computed inside the row; one partial aggregation carries a few numbers.
    """
    if list(quantile_list) != sorted(quantile_list) or not all(0 <= q <= 1 for q in quantile_list):
        raise ValueError("quantiles must be ascending and lie in [0, 1]")
    qs = sorted({*cutoff, *quantile_list})
    found = images.select(quantiles(F.col(column)["data"], qs).alias("q"))
    at = lambda q: F.get("q", F.lit(qs.index(q)))
    slope = F.lit(100.0) / F.nullif(at(cutoff[1]) - at(cutoff[0]), F.lit(0.0))
    rows = found.select(F.coalesce(slope, F.lit(0.0)).alias("s"), at(cutoff[0]).alias("lo"), F.explode(F.array(*(F.struct(F.lit(q).alias("quantile"), at(q).alias("x")) for q in quantile_list))).alias("e"))
    return rows.groupBy(F.col("e.quantile").alias("quantile")).agg((F.avg(F.col("s") * F.col("e.x")) + F.avg(-F.col("s") * F.col("lo"))).alias("value"))


@bound
def histogram_standardize(img: Column, values: list[float], *, quantile_list=QUANTILES, cutoff=(0.01, 0.99)) -> Column:
    """Piecewise-linear map of the image's quantiles to the landmark values; end segments extrapolate, flat ones have slope 0."""
    if len(values) != len(quantile_list):
        raise ValueError("as many landmarks as quantiles are needed")
    n = len(values)

    def mapped(p: Column) -> Column:
        x0 = lambda s: F.get(p, s.cast("int"))
        y = F.array(*map(F.lit, map(float, values)))

        def one(x: Column) -> Column:
            seg = sum(((x > F.get(p, F.lit(k))).cast("int") for k in range(2, n - 1)), (x > F.get(p, F.lit(1))).cast("int"))

            def line(s: Column) -> Column:
                dx = x0(s + 1) - x0(s)
                slope = F.when(F.abs(dx) < 1e-5, F.lit(0.0)).otherwise((F.get(y, (s + 1).cast("int")) - F.get(y, s.cast("int"))) / F.nullif(dx, F.lit(0.0)))
                return slope * x + (F.get(y, s.cast("int")) - slope * x0(s))

            return let(seg, line)

        return F.transform(img["data"], one)

    return replace(img, data=let(quantiles(img["data"], list(quantile_list)), mapped))


@bound
def labels_to_image(seg: Column, key: Column, stats: dict[int, tuple[float, float]], *, default=(0.5, 0.05), seed: int = 0) -> Column:
    """A new scalar image: every label's tissue has Gaussian values of its mean and deviation, seeded by row and voxel."""
    starts = F.array(*(rng.base(seed, f"tissue.{k}", key) for k in "uv"))

    def drawn(b: Column) -> Column:
        def one(v: Column, p: Column) -> Column:
            m, s = F.lit(float(default[0])), F.lit(float(default[1]))
            for label, (x, y) in sorted(stats.items()):
                m, s = F.when(v == label, float(x)).otherwise(m), F.when(v == label, float(y)).otherwise(s)
            return m + s * rng.voxel_normal(F.get(b, F.lit(0)), F.get(b, F.lit(1)), p)

        return F.transform(seg["data"], one)

    return replace(seg, data=let(starts, drawn))


@bound
def median(img: Column) -> Column:
    return quantile(img["data"], 0.5)


@bound
def otsu(img: Column) -> Column:
    """The threshold of the largest between-class variance over the sorted values; the first strict maximum wins."""
    v = F.array_sort(img["data"])

    def scan(s: Column) -> Column:
        n = F.size(s)
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
        start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"), F.get(s, F.lit(0)).alias("t"))

        def step(a: Column, x: Column) -> Column:
            k, low = a["k"] + 1, a["sum"] + x
            gap = low / k - (total - low) / F.nullif(n - k, F.lit(0))
            var = F.coalesce(k / n * (1 - k / n) * gap * gap, F.lit(-1.0))
            better = (var > a["best"]) & (k < n)
            return F.struct(k.alias("k"), low.alias("sum"), F.when(better, var).otherwise(a["best"]).alias("best"), F.when(better, x).otherwise(a["t"]).alias("t"))

        return F.aggregate(s, start, step, lambda a: a["t"])

    return let(v, scan)
