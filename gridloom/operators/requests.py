"""Planning of byte ranges: offsets, flattening, merging and coalescing, as queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled


def element_offset(begin: int, shape: Sequence[int], size: int, recsize: int | None = None) -> Column:
    """Byte offset of a cell; with ``recsize`` i0 is the record."""
    out, inner = F.lit(0).cast("long"), 1
    first = 1 if recsize is not None else 0
    for k in range(len(shape) - 1, first - 1, -1):
        out = out + F.col(f"i{k}") * inner
        inner *= shape[k]
    out = out * size + begin
    return out + F.col("i0") * recsize if recsize is not None else out


def flatten(cells: DataFrame, rank: int, offset: Column, size: int) -> DataFrame:
    """One range (off, len) for each contiguous row: all coordinates but the last."""
    return cells.withColumn("off", offset).groupBy(*[f"i{k}" for k in range(rank - 1)]).agg(F.min("off").alias("off"), (F.count(F.lit(1)) * size).alias("len"))


#: Parts that ranges are spread over by offset: one for so many ranges, and at most so many.
PART_RANGES, MOST_PARTS = 1_000_000, 1000


def _parted(ranges: DataFrame, *key: str) -> DataFrame:
    """``ranges`` with ``part``, which rises with the offset; rows of a part (and ``key``) share a task.

    The ranges are computed once, whatever they come from.  Bounds are quantiles of the offset: at most ``MOST_PARTS`` numbers
    come to the driver.
    """
    ranges = settled(ranges)
    n = min(MOST_PARTS, max(8, ranges.count() // PART_RANGES))
    bounds = ranges.agg(F.percentile_approx("off", [k / n for k in range(1, n)], 10 * n)).first()[0]
    bounds = F.lit(sorted(set(bounds or [])) or [0])
    return ranges.withColumn("part", F.size(F.filter(bounds, lambda x: x <= F.col("off")))).repartition(*key, "part")


def _carried(parts: DataFrame, key: list[str], value: Column) -> DataFrame:
    """For each part ``value`` over the parts before it; ``parts`` has a row a part, so its window is small."""
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*[F.col(k).alias(f"of_{k}") for k in key], F.col("part").alias("of_part"), value.over(before).alias("carried"))


def _with_carried(rows: DataFrame, carried: DataFrame, key: list[str]) -> DataFrame:
    same = F.col("part") == F.col("of_part")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return rows.join(carried, same).drop("of_part", *[f"of_{k}" for k in key])


def coalesce_ranges(ranges: DataFrame, by: str | None = None) -> DataFrame:
    """Adjacent and overlapping ranges merged.  ``by`` names the file or aggregator, in which ranges are ordered.

    No task sees a whole file: each part of the offsets is scanned on its own, and what reaches into it from the parts before
    it (their furthest end, then the number of islands begun) comes from tables with a row a part.
    """
    key = [by] if by else []
    r = _parted(ranges, *key).groupBy(*key, "part", "off").agg((F.col("off") + F.max("len")).alias("end"))
    ends = r.groupBy(*key, "part").agg(F.max("end").alias("end"))
    reached = _with_carried(r, _carried(ends, key, F.max("end")), key)
    here = Window.partitionBy(*key, "part").orderBy("off")
    so_far = F.greatest(F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1)), "carried")
    marked = settled(reached.withColumn("fresh", F.coalesce((F.col("off") > so_far).cast("long"), F.lit(1))).drop("carried"))
    begun = marked.groupBy(*key, "part").agg(F.sum("fresh").alias("fresh"))
    counted = _with_carried(marked.withColumn("island", F.sum("fresh").over(here)), _carried(begun, key, F.sum("fresh")), key)
    island = counted.withColumn("island", F.col("island") + F.coalesce("carried", F.lit(0)))
    out = island.groupBy(*key, "island").agg(F.min("off").alias("off"), F.max("end").alias("end"))
    return out.select(*key, "off", (F.col("end") - F.col("off")).alias("len"))


def merge_sorted(lists: list[DataFrame]) -> DataFrame:
    """Ranges of several lists with their rank in order of offset: places within a part, after those of the parts before."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    r = _parted(out)
    sizes = r.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    placed = r.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("off", "len")).cast("long"))
    placed = _with_carried(placed, _carried(sizes, [], F.sum("n")), [])
    return placed.withColumn("rank", F.col("rank") + F.coalesce("carried", F.lit(0))).drop("part", "carried")


def scatter(ranges: DataFrame, requests: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """Which part of which range serves each request, both with off and len: req, off, len of every piece.

    ``ranges`` are coalesced, so a byte is served once.  Both sides are cut at multiples of ``cell`` bytes and meet by an equal
    join on the cell, never by comparing all with all; neighbouring pieces are then one again.
    """

    def cells(df: DataFrame) -> DataFrame:
        low = F.greatest(F.col("off"), F.col("cell") * cell)
        high = F.least(F.col("off") + F.col("len"), (F.col("cell") + 1) * cell)
        cut = df.filter("len > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("off") / cell), F.floor((F.col("off") + F.col("len") - 1) / cell))))
        return cut.withColumn("lo", low).withColumn("hi", high)

    a = cells(ranges.select(F.col("off").alias("range"), "off", "len")).select("cell", "range", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = cells(requests.select("req", "off", "len")).select("cell", "req", F.col("off").alias("asked"), F.col("len").alias("n_asked"), "lo", "hi")
    low, high = F.greatest("a_lo", "lo"), F.least("a_hi", "hi")
    pieces = b.join(a, "cell").filter(low < high).select("req", "asked", "n_asked", "range", low.alias("lo"), high.alias("hi"))
    whole = pieces.groupBy("req", "asked", "n_asked", "range").agg(F.min("lo").alias("off"), F.max("hi").alias("hi"))
    return whole.select("req", "off", (F.col("hi") - F.col("off")).alias("len"))


def aggregate(ranges: DataFrame, n: int, size: int) -> DataFrame:
    """Bytes each of ``n`` aggregators gets when a file of ``size`` bytes is split evenly among them."""
    each = -(-size // n)
    return ranges.groupBy(F.floor(F.col("off") / each).cast("long").alias("aggregator")).agg(F.sum("len").alias("bytes"), F.count(F.lit(1)).alias("n_ranges"))


def gather(cells: DataFrame, offset: Column, n: int) -> DataFrame:
    """Cells sent to ``n`` aggregators by ranges of their offset, each with its own in order, so that it writes one stretch of a file."""
    sent = cells.withColumn("__off", offset).repartitionByRange(n, "__off").sortWithinPartitions("__off")
    return sent.drop("__off")


def gaps(layout: DataFrame) -> DataFrame:
    """Variables (name, begin, len) with the gap before each; for a catalogue, which is small."""
    before = F.lag(F.col("begin") + F.col("len")).over(Window.orderBy("begin"))
    return layout.select("name", "begin", (F.col("begin") + F.col("len")).alias("end"), F.coalesce(F.col("begin") - before, F.lit(0)).alias("gap"))


def has_gap(layout: DataFrame) -> int:
    """1 if any variable begins beyond the end of the one before it, else 0."""
    return int(not gaps(layout).filter("gap > 0").isEmpty())


def bounds(cells: DataFrame, offset: Column, size: int) -> DataFrame:
    """The byte range that each request (req) spans: ``first``, and ``past`` its last byte."""
    return cells.withColumn("off", offset).groupBy("req").agg(F.min("off").alias("first"), (F.max("off") + size).alias("past"))


def record_offsets(layout: DataFrame, numrecs: int, recsize: int) -> DataFrame:
    """A row for each fixed variable (record -1) and for each record of a record variable; ``layout``: name, begin, len, is_rec."""
    records = layout.sparkSession.range(numrecs).withColumnRenamed("id", "record")
    fixed = layout.filter("not is_rec").select("name", F.lit(-1).cast("long").alias("record"), "begin", (F.col("begin") + F.col("len")).alias("end"))
    begin = F.col("begin") + F.col("record") * recsize
    grown = records.join(F.broadcast(layout.filter("is_rec")))  # a row a variable: bounded by the catalogue
    return fixed.unionByName(grown.select("name", "record", begin.alias("begin"), (begin + F.col("len")).alias("end")))


def subfile_requests(requests: DataFrame, size: int, n_files: int) -> DataFrame:
    """Requests (req, start, count) along the split dimension, cut at the bounds ceil(size / n * k) of the files."""
    of = lambda i: F.floor(i * n_files / size)
    cut = requests.filter("count > 0").withColumn("file_id", F.explode(F.sequence(of(F.col("start")), of(F.col("start") + F.col("count") - 1))))
    bound = lambda k: F.ceil(k * size / n_files)
    low = F.greatest(F.col("start"), bound(F.col("file_id")))
    high = F.least(F.col("start") + F.col("count"), bound(F.col("file_id") + 1))
    return cut.select("req", "file_id", low.alias("start"), (high - low).alias("count"))
