"""Arithmetic of array columns, and element-wise aggregates that need no explode."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vec_norm(a: Column) -> Column:
    return F.sqrt(vec_dot(a, a))


def vec_l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def vec_cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    norms = vec_norm(a) * vec_norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(vec_dot(a, b) / norms)


def elementwise(agg, feat: str, dim: int, *args) -> Column:
    """An array of agg over each of the dim elements of an array column: one aggregate each, combined before the shuffle."""
    return F.array(*[agg(F.col(feat)[i].cast("double"), *args) for i in range(dim)])


def path_stem(path: Column) -> Column:
    """The file name without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def renamed(path: Column, suffix: str) -> Column:
    """The path with a suffix before its last extension."""
    stem = path_stem(path)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), stem, F.lit(suffix), F.substr(name, F.length(stem) + 1))
