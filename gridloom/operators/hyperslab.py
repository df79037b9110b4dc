"""Reading parts of a variable: points, boxes, strides, mapped memory and lists of boxes.

A variable is a table of cells: one coordinate column i0, i1, ... for each dimension and the value v.  All selections are
predicates on coordinates, so they reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import ArrayError, Code


def validate(shape: Sequence[int], start, count, stride=None, *, record: bool = False, write: bool = False, relaxed: bool = True, version: int = 5) -> None:
    """The checks of one request, in their order.  ``shape``: lengths, the record dimension with its present length."""
    n = len(shape)
    if not n:
        return
    if start is None or len(start) < n or start[0] < 0:
        raise ArrayError(Code.INVALCOORDS, "start")
    if record and version != 5 and start[0] > 2**32 - 1:
        raise ArrayError(Code.INVALCOORDS, "record number")
    grows = record and write
    if record and not write and shape[0] == 0 and (count is None or count[0] > 0):
        raise ArrayError(Code.INVALCOORDS, "no records")
    for k in range(n):
        if grows and k == 0:
            continue
        none = count is not None and len(count) > k and count[k] == 0
        if start[k] < 0 or start[k] > shape[k] or start[k] == shape[k] and not (relaxed and none):
            raise ArrayError(Code.INVALCOORDS, f"dimension {k}")
    if count is None or len(count) < n:
        raise ArrayError(Code.EDGE, "count")
    for k in range(n):
        if count[k] < 0:
            raise ArrayError(Code.NEGATIVECNT, f"dimension {k}")
        if grows and k == 0 or count[k] == 0:
            continue
        step = stride[k] if stride is not None else 1
        if step > 0 and start[k] + (count[k] - 1) * step >= shape[k]:
            raise ArrayError(Code.EDGE, f"dimension {k}")
    if stride is not None and any(s <= 0 for s in stride):
        raise ArrayError(Code.STRIDE)


def box(rank: int, start, count, stride=None) -> Column:
    """The predicate of a hyperslab; a stride of one adds no test."""
    out = F.lit(True)
    for k in range(rank):
        i, t = F.col(f"i{k}"), stride[k] if stride is not None else 1
        out = out & (i >= start[k]) & (i < start[k] + max(0, (count[k] - 1) * t + 1 if count[k] else 0))
        if t != 1:
            out = out & ((i - start[k]) % t == 0)
    return out


def get_var1(df: DataFrame, index) -> DataFrame:
    return df.filter(box(len(index), index, [1] * len(index)))


def get_vara(df: DataFrame, start, count) -> DataFrame:
    return df.filter(box(len(start), start, count))


def get_vars(df: DataFrame, start, count, stride) -> DataFrame:
    return df.filter(box(len(start), start, count, stride))


def place(rank: int, start, stride, imap) -> Column:
    """Memory address of a cell: the sum of its place along each dimension times the map."""
    out = F.lit(0).cast("long")
    for k in range(rank):
        out = out + F.floor((F.col(f"i{k}") - start[k]) / (stride[k] if stride is not None else 1)) * imap[k]
    return out.cast("long")


def get_varm(df: DataFrame, start, count, stride, imap) -> DataFrame:
    """Cells of a hyperslab with ``address``, their place in the caller's memory."""
    stride = stride or [1] * len(start)
    return get_vars(df, start, count, stride).withColumn("address", place(len(start), start, stride, imap))


def from_memory(memory: DataFrame, start, count, stride, imap) -> DataFrame:
    """Cells of a hyperslab from the caller's memory (address, v): the inverse of ``get_varm``, for mapped writes.

    The box's cells are generated and meet the memory by an equal join on the address, so any map will do, also one that
    takes several cells from one address.
    """
    from .update import grid

    rank, stride = len(start), stride or [1] * len(start)
    address, cells = F.lit(0).cast("long"), []
    for k in range(rank):
        address = address + F.col(f"i{k}") * imap[k]
        cells.append((F.col(f"i{k}") * stride[k] + start[k]).alias(f"i{k}"))
    wanted = grid(memory.sparkSession, list(count)).select(*cells, address.alias("address"))
    return wanted.join(memory.select("address", "v"), "address").drop("address")


def boxes_frame(spark, boxes: Sequence[tuple]) -> DataFrame:
    """A list of (start, count) as a table: box, s0.., c0..; a count of None is all ones."""
    rank = len(boxes[0][0])
    rows = [(b, *map(int, s), *map(int, c or [1] * rank)) for b, (s, c) in enumerate(boxes)]
    return spark.createDataFrame(rows, ", ".join(["box long", *[f"s{k} long" for k in range(rank)], *[f"c{k} long" for k in range(rank)]]))


#: Lists of at most so many boxes are compared with each cell; longer ones meet the cells by an equal join, broadcast up to
#: the second bound.
FEW_BOXES, BROADCAST_BOXES = 16, 100_000


def get_varn(df: DataFrame, boxes: Sequence[tuple]) -> DataFrame:
    """The cells of each box, with its number; overlapping and repeated boxes each give theirs."""
    if not boxes:
        return df.filter("false").select(F.lit(0).cast("long").alias("box"), *df.columns)
    rank = len(boxes[0][0])
    boxes = [(s, c or [1] * rank) for s, c in boxes]
    b = boxes_frame(df.sparkSession, boxes)
    inside = F.lit(True)
    for k in range(rank):
        inside = inside & (F.col(f"i{k}") >= F.col(f"s{k}")) & (F.col(f"i{k}") < F.col(f"s{k}") + F.col(f"c{k}"))
    low = [min(s[k] for s, _ in boxes) for k in range(rank)]
    high = [max(s[k] + c[k] for s, c in boxes) for k in range(rank)]
    df = df.filter(box(rank, low, [h - a for a, h in zip(low, high, strict=True)]))
    if len(boxes) <= FEW_BOXES:
        joined = df.join(F.broadcast(b), inside)
    else:
        # Strips as wide as the boxes are on average along the first dimension: at most three rows a box in all.
        width = max(1, -(-sum(c[0] for _, c in boxes) // len(boxes)))
        strips = b.filter("c0 > 0").withColumn("strip", F.explode(F.sequence(F.floor(F.col("s0") / width), F.floor((F.col("s0") + F.col("c0") - 1) / width))))
        strips = F.broadcast(strips) if len(boxes) <= BROADCAST_BOXES else strips
        joined = df.join(strips, (F.floor(F.col("i0") / width) == F.col("strip")) & inside)
    return joined.select("box", *[f"i{k}" for k in range(rank)], "v")


def mget(parts: dict[str, DataFrame]) -> DataFrame:
    """Several variables' cells in one table: var, coordinates (null beyond a variable's rank) and v as double."""
    rank = max(sum(c.startswith("i") for c in df.columns) for df in parts.values())
    out = None
    for name, df in parts.items():
        have = [f"i{k}" for k in range(rank) if f"i{k}" in df.columns]
        cols = [F.col(f"i{k}") if f"i{k}" in have else F.lit(None).cast("long").alias(f"i{k}") for k in range(rank)]
        one = df.select(F.lit(name).alias("var"), *cols, F.col("v").cast("double").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def decompose(pattern: str, shape: Sequence[int], owners: Sequence[int]) -> Column:
    """Owner of a cell under a decomposition: block-block, *-cyclic, block-* or *-block over i0, i1."""
    part = lambda k, n: F.floor(F.col(f"i{k}") / -(-shape[k] // n))
    if pattern == "block-block":
        out = part(0, owners[0]) * owners[1] + part(1, owners[1])
    elif pattern == "*-cyclic":
        out = F.col("i1") % owners[0]
    elif pattern == "block-*":
        out = part(0, owners[0])
    elif pattern == "*-block":
        out = part(1, owners[0])
    else:
        raise ArrayError(Code.INVAL, pattern)
    return out.cast("long")


def subfile(shape: Sequence[int], n_files: int, dim: int = 0) -> Column:
    """File of a cell when a variable is split along one dimension into contiguous ranges, bounds ceil(size / n * k)."""
    size = shape[dim]
    return F.floor(F.col(f"i{dim}") * n_files / size).cast("long")
