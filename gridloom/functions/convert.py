"""Range-checked type conversion and missing values, as column expressions.

A value that the target type cannot hold becomes a fill value and is counted; nothing stops.  Reading takes the default
fill of the memory type, writing the fill of the variable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import ArrayError, Code, external, fill_literal

_REAL = ("float", "double")


def _same_kind(source: str, target: str) -> None:
    if (source == "char") != (target == "char"):
        raise ArrayError(Code.CHAR, f"{source} to {target}")


def in_range(value: Column, source: str, target: str) -> Column:
    """Whether the target type can hold the value.  NaN fits a real type and no integer."""
    s, t = external(source), external(target)
    if source == target or s.low is None:
        return F.lit(True)
    if source in _REAL:
        v = value.cast("double")
        if target in _REAL:
            return F.isnan(v) | v.between(float(t.low), float(t.high))
        if t.high >= 2**53:  # the bound itself is no double: below 2**63 or 2**64
            return ~F.isnan(v) & (v > float(t.low) - 1.0 if t.low == 0 else v >= float(t.low)) & (v < float(t.high))
        return ~F.isnan(v) & (v >= float(t.low)) & (v <= float(t.high))
    if target in _REAL or (t.low <= s.low and t.high >= s.high):
        return F.lit(True)
    v = value.cast("decimal(20,0)")
    return (v >= F.lit(str(t.low)).cast("decimal(20,0)")) & (v <= F.lit(str(t.high)).cast("decimal(20,0)"))


def convert(value: Column, source: str, target: str, fill: Column | None = None, erange_fill: bool = True) -> Column:
    """The value in the target's Spark type: truncated towards zero, or the fill if it is out of range.

    ``fill``: the variable's fill when writing; the target's default otherwise.  With ``erange_fill`` off, out of range is null.
    """
    _same_kind(source, target)
    t = external(target)
    if source == target or target == "char":
        return value
    fill = F.lit(fill_literal(t)).cast(t.spark) if fill is None else fill.cast(t.spark)
    whole = value
    if source in _REAL and target not in _REAL:  # beyond 2**52 a double has no fraction
        v = value.cast("double")
        cut = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")
        whole = F.when(F.abs(v) < float(2**52), cut).otherwise(v)
    cast = whole.try_cast(t.spark)
    ok = in_range(value, source, target)
    if not erange_fill:
        return F.when(ok, cast)
    return F.when(value.isNull(), F.lit(None)).when(ok, cast).otherwise(fill)


def wrap_uchar(value: Column) -> Column:
    """An unsigned char buffer written to a byte variable of CDF-1 or CDF-2: bits reinterpreted, no range error."""
    return F.when(value > 127, value - 256).otherwise(value).cast("byte")


def unwrap_uchar(value: Column) -> Column:
    return F.pmod(value.cast("int"), F.lit(256)).cast("short")


def count_range_errors(df: DataFrame, value: str, source: str, targets: list[str]) -> DataFrame:
    """One row a target type: ``xtype`` and how many values it cannot hold."""
    row = df.agg(*[F.coalesce(F.sum((~in_range(F.col(value), source, t)).cast("long")), F.lit(0)).alias(t) for t in targets])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("xtype"), F.col(t).alias("n_errors")) for t in targets])).alias("x")).select("x.*")


def fill_of(xtype: str, fill=None) -> Column:
    t = external(xtype)
    return F.lit(fill_literal(t) if fill is None else fill).cast(t.spark)


def with_nulls(df: DataFrame, value: str, xtype: str, fill=None) -> DataFrame:
    """Fill values as nulls."""
    return df.withColumn(value, F.nullif(F.col(value), fill_of(xtype, fill)))


def is_fill(value: Column, xtype: str, fill=None) -> Column:
    """As a dump sees it: equal, or for reals within an epsilon of the type; a byte has no default fill."""
    if xtype == "byte" and fill is None:
        return F.lit(False)
    f = fill_of(xtype, fill)
    if xtype in _REAL:
        eps = 1.1920929e-07 if xtype == "float" else 2.220446049250313e-16
        v, d = value.cast("double"), f.cast("double")
        return (F.signum(v) == F.signum(d)) & (F.abs(v - d) <= eps * F.abs(d))
    return value == f
