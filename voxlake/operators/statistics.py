"""Statistics of an image, inside the row; every intermediate is evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.image import bound, let, mean, quantiles, stddev


@bound
def statistics(img: Column, qs: list[float]) -> Column:
    """A struct of mean, std (unbiased), low, high and the quantiles qs."""
    rest = lambda m: F.struct(m.alias("mean"), stddev(img["data"], m).alias("std"), F.array_min(img["data"]).alias("low"), F.array_max(img["data"]).alias("high"), quantiles(img["data"], qs).alias("quantiles"))
    return let(mean(img["data"]), rest)


@bound
def channel_covariance(img: Column) -> Column:
    """The unbiased covariances of channels, row by row of the matrix."""
    n = (F.size(img["data"]) / img["c"]).cast("int")
    channels = F.transform(F.sequence(F.lit(0), img["c"] - 1), lambda c: F.slice(img["data"], c * n + 1, n))
    centred = F.transform(channels, lambda d: let(mean(d), lambda m: F.transform(d, lambda x: x - m)))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (n - 1)
    return let(centred, lambda all_: F.flatten(F.transform(all_, lambda a: F.transform(all_, lambda b: product(a, b)))))
