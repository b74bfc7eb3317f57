"""Label operators on image structs with integer data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.image import bound, let, replace


@bound
def remap(img: Column, table: dict[int, int]) -> Column:
    """All at once: every voxel is looked up by its original label."""
    if not table:
        return img
    lookup = F.create_map(*(F.lit(int(v)) for pair in table.items() for v in pair))
    return replace(img, data=F.transform(img["data"], lambda x: F.coalesce(F.try_element_at(lookup, x), x)))


@bound
def remove(img: Column, labels: list[int], background: int = 0) -> Column:
    return replace(img, data=F.transform(img["data"], lambda x: F.when(x.isin(labels), background).otherwise(x)))


@bound
def sequential(img: Column) -> Column:
    """The sorted distinct labels become 0, 1, 2, ..."""
    return replace(img, data=let(F.array_sort(F.array_distinct(img["data"])), lambda u: F.transform(img["data"], lambda x: (F.array_position(u, x) - 1).cast("int"))))


@bound
def one_hot(img: Column, classes: int) -> Column:
    """Channel 0 as one channel of 0 and 1 for every class."""
    n = F.size(img["data"]) / img["c"]
    first = F.slice(img["data"], 1, n.cast("int"))
    data = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.transform(first, lambda x: (x == k).cast("double"))))
    return replace(img, c=F.lit(classes), data=data)


@bound
def arg_max(img: Column) -> Column:
    """The channel of the largest value of each voxel, the first of equals: the inverse of one_hot."""
    n = (F.size(img["data"]) / img["c"]).cast("int")
    each = lambda p: F.transform(F.sequence(F.lit(0), img["c"] - 1), lambda k: F.get(img["data"], k * n + p))
    data = F.transform(F.sequence(F.lit(0), n - 1), lambda p: let(each(p), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int")))
    return replace(img, c=F.lit(1), data=data)


@bound
def unique(img: Column) -> Column:
    return F.array_sort(F.array_distinct(img["data"]))
