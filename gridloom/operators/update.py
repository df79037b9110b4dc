"""Writing parts of a variable: merges of old and new cells, batches with overlap, filling, and log replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.convert import fill_of
from .hyperslab import box


def coords(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[:1] == "i" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def put(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of ``old`` overwritten by ``new``, and the new ones that ``old`` lacks.  Calls apply in order, so a later put wins."""
    on = coords(old)
    if not on:
        return new.select("v")
    b = new.select(*on, F.col("v").alias("new_v"), F.lit(True).alias("is_new"))
    return old.join(b, on, "full_outer").select(*on, F.when(F.col("is_new"), F.col("new_v")).otherwise(F.col("v")).alias("v"))


#: Cells of a box that are broadcast against the old cells.
BROADCAST_CELLS = 1_000_000


def put_box(old: DataFrame, new: DataFrame, start, count, stride=None) -> DataFrame:
    """``put`` of cells that all lie in one box.  Nothing of ``old`` is shuffled where the box has at most ``BROADCAST_CELLS`` cells
    (its size says so), or where ``new`` has every cell of the box, which is counted.  ``old`` is read once, so many puts in
    a row stay one pass."""
    on = coords(old)
    if not on:
        return new.select("v")
    n = reduce(lambda a, b: a * b, count, 1)
    if n > BROADCAST_CELLS and new.select(*on).distinct().count() == n:
        kept = old.filter(~box(len(on), start, count, stride))
    else:
        written = new.select(*[F.col(k).alias(f"new_{k}") for k in on])
        same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"new_{k}") for k in on])
        kept = old.join(F.broadcast(written) if n <= BROADCAST_CELLS else written, same, "left_anti")
    return kept.select(*on, "v").unionByName(new.select(*on, "v"))


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """``put`` for cells of records that ``old`` surely lacks: nothing is joined or shuffled."""
    on = coords(old)
    return old.select(*on, "v").unionByName(new.select(*on, "v"))


def numrecs_after(numrecs: Column | int, start: int, count: int, stride: int = 1) -> Column:
    """Records after a write along the record dimension."""
    return F.greatest(F.lit(numrecs) if isinstance(numrecs, int) else numrecs, F.lit(start + (count - 1) * stride + 1 if count else 0))


def settle(cells: DataFrame) -> DataFrame:
    """One value a cell of a batch of boxes: of each row segment the lower start offset wins, then the lower box.

    ``cells``: box, start_offset (of the segment a cell was written by), coordinates and v.
    """
    on = coords(cells)
    first = F.row_number().over(Window.partitionBy(*on).orderBy("start_offset", "box"))
    return cells.withColumn("__n", first).filter("__n = 1").select(*on, "v")


def put_varn(old: DataFrame, cells: DataFrame) -> DataFrame:
    return put(old, settle(cells))


def replay(log: DataFrame) -> DataFrame:
    """The cells of a write-ahead log (seq, coordinates, v): the last write of each."""
    on = coords(log)
    return log.groupBy(*on).agg(F.max_by("v", "seq").alias("v"))


def grid(spark, shape: list[int]) -> DataFrame:
    """All coordinates of a dense array."""
    total = reduce(lambda a, b: a * b, shape, 1)
    df, inner = spark.range(total), total
    cols = []
    for k, n in enumerate(shape):
        inner //= n
        cols.append((F.floor(F.col("id") / inner) % n).cast("long").alias(f"i{k}"))
    return df.select(*cols)


def densify(df: DataFrame, shape: list[int], xtype: str, fill=None) -> DataFrame:
    """Every cell of the array; those never written have the fill value."""
    on = [f"i{k}" for k in range(len(shape))]
    value = fill_of(xtype, fill)
    return grid(df.sparkSession, shape).join(df, on, "left").select(*on, F.coalesce(F.col("v"), value).alias("v"))


def fill_record(spark, record: int, inner: list[int], xtype: str, fill=None) -> DataFrame:
    """One record of fill values."""
    rest = grid(spark, inner) if inner else spark.range(1).select()
    rest = rest.select(*[F.col(f"i{k}").alias(f"i{k + 1}") for k in range(len(inner))]) if inner else spark.range(1)
    return rest.select(F.lit(record).cast("long").alias("i0"), *[f"i{k + 1}" for k in range(len(inner))], fill_of(xtype, fill).alias("v"))


def split_records(requests: DataFrame) -> DataFrame:
    """Requests (req, start, count, stride) along the record dimension, one row a record."""
    last = F.col("start") + (F.col("count") - 1) * F.col("stride")
    return requests.filter("count > 0").select("req", F.explode(F.sequence("start", last, "stride")).alias("record"))
