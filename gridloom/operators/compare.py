"""Comparing two variables or two catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .update import coords


def differs(a: Column, b: Column, absolute: float | None = None, ratio: float | None = None) -> Column:
    """As in C: unequal, and NaN differs from all.  With tolerances, passing either test is enough."""
    x, y = a.cast("double"), b.cast("double")
    nan = F.isnan(x) | F.isnan(y)
    if absolute is None and ratio is None:
        return nan | (a != b)
    gap = F.abs(x - y)
    ok = (x == y) | (gap <= F.lit(absolute or 0.0)) | (gap / F.greatest(F.abs(x), F.abs(y)) <= F.lit(ratio or 0.0))
    return nan | ~F.coalesce(ok, F.lit(False))


def diff(a: DataFrame, b: DataFrame, absolute: float | None = None, ratio: float | None = None) -> DataFrame:
    """Cells both have whose values differ: coordinates, a and b."""
    on = coords(a)
    joined = a.select(*on, F.col("v").alias("a")).join(b.select(*on, F.col("v").alias("b")), on)
    if dict(a.dtypes)["v"] == "binary":  # characters: no tolerance
        return joined.filter("a <> b")
    return joined.filter(differs(F.col("a"), F.col("b"), absolute, ratio))


def first_diff(a: DataFrame, b: DataFrame, **tolerance) -> DataFrame:
    """The first difference in row-major order."""
    found = diff(a, b, **tolerance)
    return found.orderBy(*coords(a)).limit(1)


def diff_names(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    """Catalogue rows by name: which side has them, and whether all other columns agree."""
    rest = [c for c in a.columns if c != key]
    joined = a.select(key, F.struct(*rest).alias("a")).join(b.select(key, F.struct(*rest).alias("b")), key, "full_outer")
    state = F.when(F.col("a").isNull(), "only in second").when(F.col("b").isNull(), "only in first").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return joined.select(key, state.alias("state"))
