"""Resharding by minimum-cost flow: from old shard sizes and new capacities with the fewest bytes moved.

A row belongs to the group of its text (by hash), so equal texts stay together.  A group's home is the old shard that has most
of its bytes; what lies elsewhere has to move anyway.  Groups larger than a fixed share of a new shard are units of their own;
all others of one home fall into blocks by hash.  Unit sizes (a table of bounded length) go to the driver: large units are
placed first, at home where they fit; capacities level the shards out around them; a min-cost flow from old shards to new
ones, where staying is free and moving costs its bytes, says how many bytes each pair exchanges; units then realise the flow,
and only shards that gain or lose rows are rewritten.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

#: Blocks of small groups, over all old shards.
BLOCKS = 4096
#: A group above 1 / LARGE of a new shard is a unit of its own.
LARGE = 64
#: Rows that are ranked together, about; a unit of more rows is ranked in parts.
RANKED = 100_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes from each source to each sink, of least total cost; successive shortest paths.  sum(supply) <= sum(capacity)."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost; the reverse is at index ^ 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, price: int) -> int:
        graph[a].append(len(edges))
        edges.append([b, room, price])
        graph[b].append(len(edges))
        edges.append([a, 0, -price])
        return len(edges) - 2

    for i, x in enumerate(supply):
        add(source, i, x, 0)
    ways = [[add(i, n + j, min(supply[i], capacity[j]), cost[i][j]) for j in range(m)] for i in range(n)]
    for j, x in enumerate(capacity):
        add(n + j, sink, x, 0)
    while True:
        far, by, queue = {source: 0}, {}, [source]
        while queue:  # Bellman-Ford with a queue; the graph has few nodes
            a = queue.pop(0)
            for e in graph[a]:
                b, room, price = edges[e]
                if room > 0 and far[a] + price < far.get(b, float("inf")):
                    far[b], by[b] = far[a] + price, e
                    queue.append(b)
        if sink not in far:
            return [[edges[e ^ 1][1] for e in row] for row in ways]
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = edges[by[at] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push


def levelled(load: list[int], total: int) -> list[int]:
    """What each shard takes of ``total`` further bytes so that all end as even as can be."""
    order = sorted(range(len(load)), key=lambda j: (load[j], j))
    out = [0] * len(load)
    for k in range(len(order), 0, -1):  # the k emptiest share the rest
        level, more = divmod(total + sum(load[j] for j in order[:k]), k)
        if level >= load[order[k - 1]]:
            for n, j in enumerate(order[:k]):
                out[j] = level - load[j] + (n < more)
            break
    return out


def assign(units: dict, n_old: int, n_new: int) -> tuple[dict, list[list[int]]]:
    """New shard of each unit, and the flow.  ``units``: for each the bytes it has in every old shard.

    A unit's home is the old shard with most of its bytes.  Units above 1 / LARGE of a new shard come first, largest first: where
    they go least beyond an even share, and of such shards where they move least.  Of the others each home keeps what its shard has
    room for and sends what the flow says, largest units first as long as they fit; last, units move from the fullest to
    the emptiest shard while that evens sizes out.
    """
    size = {u: sum(x) for u, x in units.items()}
    home = {u: max(range(n_old), key=lambda i: (x[i], -i)) for u, x in units.items()}
    total = sum(size.values())
    fair = -(-total // n_new)
    order = sorted(units, key=lambda u: (-size[u], u))
    at = lambda u, j: units[u][j] if j < n_old else 0
    load, new = [0] * n_new, {}
    for u in order:
        if size[u] * LARGE * n_new <= total:
            break
        j = new[u] = min(range(n_new), key=lambda j: (max(0, load[j] + size[u] - fair), size[u] - at(u, j), load[j], j))
        load[j] += size[u]
    small = [u for u in order if u not in new]
    supply = [0] * n_old
    for u in small:
        supply[home[u]] += size[u]
    flow = min_cost_flow(supply, levelled(load, sum(supply)), [[0 if i == j else 1 for j in range(n_new)] for i in range(n_old)])
    by_home = defaultdict(list)
    for u in small:
        by_home[home[u]].append(u)
    for i, own in by_home.items():
        lack = {j: flow[i][j] for j in range(n_new) if j != i}
        for u in own:
            j = max(lack, key=lambda j: (lack[j], -j), default=i)
            if lack and (lack[j] >= size[u] or i >= n_new):  # a shard that is given up sends all it has
                lack[j] -= size[u]
            else:
                j = i
            new[u] = j
            load[j] += size[u]
    held = defaultdict(list)
    for u in reversed(order):
        held[new[u]].append(u)
    for _ in range(64 * n_new):
        a, b = int(np.argmax(load)), int(np.argmin(load))
        gap = load[a] - load[b]
        # away from where it is not at home before its home loses it
        fits = [u for u in held[a] if 0 < size[u] < gap]
        if not fits:
            break
        u = min(fits, key=lambda u: (abs(gap - 2 * size[u]) - (size[u] if home[u] == b else 0), home[u] == a, u))
        held[a].remove(u)
        held[b].append(u)
        new[u] = b
        load[a] -= size[u]
        load[b] += size[u]
    _exchange(units, size, [u for u in order if size[u] * LARGE * n_new > total], new, load, at)
    return new, flow


def _exchange(units: dict, size: dict, large: list, new: dict, load: list[int], at) -> None:
    """Large units change places, alone or in pairs, while fewer bytes move and the shards stay as even."""

    def after(*moves: tuple) -> int:
        then = list(load)
        for u, j in moves:
            then[new[u]] -= size[u]
            then[j] += size[u]
        return max(then) - min(then)

    def gain(*moves: tuple) -> int:
        return sum(at(u, j) - at(u, new[u]) for u, j in moves)

    better = True
    while better:
        better, spread = False, max(load) - min(load)
        away = [u for u in large if at(u, new[u]) < max(units[u][: len(load)])]
        single = [((u, j),) for u in away for j in range(len(load)) if j != new[u]]
        others = [((v, j),) for v in large for j in range(len(load)) if j != new[v]]
        if len(single) * len(others) > 20_000:  # only exchanges of two places
            others = []
        ways = single + [x + y for x in single for y in others if x[0][0] != y[0][0]] + [((u, new[v]), (v, new[u])) for u in away for v in large if new[u] != new[v]]
        good = [w for w in ways if gain(*w) > 0 and after(*w) <= spread]
        if good:
            for u, j in max(good, key=lambda w: gain(*w)):
                load[new[u]] -= size[u]
                new[u] = j
                load[j] += size[u]
            better = True


def _measured(rows: DataFrame, n_new: int) -> tuple[int, DataFrame, list]:
    """All bytes, the homes of groups that lie in several old shards, and the large groups: hash, bytes and rows."""
    groups = c.materialize(rows.groupBy("__gl_group", "old_shard").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    best = F.max_by("old_shard", F.struct("size", -F.col("old_shard")))
    whole = groups.groupBy("__gl_group").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards"), best.alias("home"))
    whole = c.materialize(whole.filter((F.col("shards") > 1) | (F.col("size") * LARGE * n_new > total)))
    large = whole.filter(F.col("size") * LARGE * n_new > total).select("__gl_group", "size", "n").collect()  # fewer than LARGE * n_new
    return total, whole.select(F.col("__gl_group").alias("__gl_g"), F.col("home").alias("__gl_home")), large


def reshard(docs: DataFrame, n_new: int = 8, n_old: int = 6, id_col: str = "doc_id", text_col: str = "text", old_col: str | None = None, keep_columns: bool = False) -> DataFrame:
    """Each row with its ``old_shard``, new ``shard`` and ``slot`` (gapless from 0 in the shard), by the law ``bytes``.

    ``old_col`` names the shard (0 to n_old - 1; null is 0) a row is in; without one the old layout is id modulo n_old.  Rows of
    equal text end in one shard, unless they are more than an even share of all bytes: such a group is dealt out in parts by
    id.  The size of a row is the UTF-8 bytes of its text and 1.  Returns also ``size`` and ``text_crc32``; with
    ``keep_columns`` all columns of ``docs`` too, where those of the five names are replaced.

    Null text has no bytes; empty tables give an empty result; rows without an id and repeated rows each have a slot.
    """
    spark = docs.sparkSession
    text = c.quoted(text_col)
    given = c.quoted(old_col) if old_col else F.pmod(c.quoted(id_col), F.lit(n_old))
    made = {
        "old_shard": F.coalesce(given, F.lit(0)).cast("int"), "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        "text_crc32": F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))), "__gl_group": F.xxhash64(F.coalesce(text, F.lit(""))),
        # rows of one group apart, also where ids are missing
        "__gl_row": F.xxhash64(*[c.quoted(x) for x in docs.columns if x != text_col]),
    }
    plain = [x for x in docs.columns if x not in (*made, "shard", "slot")] if keep_columns else [id_col]
    wide = docs.select(*[c.quoted(x) for x in plain], *[v.alias(k) for k, v in made.items()])
    rows = c.materialize(wide.select(id_col, *made))  # a few numbers a row
    total, homes, large = _measured(rows, n_new)
    n_rows = rows.count()
    ranked = max(16, min(RANKED, n_rows // 1024))
    # For each large group: its number, whether it is torn (only if it is more than a shard), and its parts.
    own = [(g, k, size * n_new > total, -(-n // ranked)) for k, (g, size, n) in enumerate(sorted(large))]
    table = spark.createDataFrame(own, "__gl_large long, __gl_k int, __gl_torn boolean, __gl_parts int")
    per_home, pieces = max(1, BLOCKS // n_old), 8
    small_parts = max(1, n_rows // BLOCKS // RANKED)
    home = F.broadcast(homes) if homes.count() <= 1_000_000 else homes

    def in_units(df: DataFrame) -> DataFrame:
        df = df.join(home, F.col("__gl_group") == F.col("__gl_g"), "left").join(F.broadcast(table), F.col("__gl_group") == F.col("__gl_large"), "left")
        is_small = F.col("__gl_k").isNull()
        block = F.coalesce("__gl_home", "old_shard") * per_home + F.pmod("__gl_group", F.lit(per_home))
        piece = F.when(F.col("__gl_torn"), F.col("old_shard") * pieces + F.pmod("__gl_row", F.lit(pieces))).otherwise(0)
        unit = F.when(is_small, block).otherwise(-1 - (F.col("__gl_k").cast("long") * n_old * pieces + piece))
        part = F.when(is_small, F.pmod(F.shiftright("__gl_group", 20), F.lit(small_parts))).otherwise(F.pmod(F.shiftright("__gl_row", 16), F.col("__gl_parts")))
        return df.select(*[c.quoted(x) for x in wide.columns if x in df.columns], unit.cast("long").alias("__gl_unit"), part.cast("int").alias("__gl_part"))

    # At most a row for each unit, part and old shard.
    measured = in_units(rows).groupBy("__gl_unit", "__gl_part", "old_shard").agg(F.sum("size"), F.count(F.lit(1))).collect()
    units, counts = defaultdict(lambda: [0] * n_old), defaultdict(int)
    for u, part, shard, size, n in measured:
        units[u][shard] += size
        counts[u, part] += n
    new, _ = assign(dict(units), n_old, n_new)
    # The parts of a shard, in order, form files of about ``ranked`` rows; a row's slot is its file's first one and its rank there.
    filled, opened, files = [0] * n_new, [(0, 0)] * n_new, []
    for (u, part), n in sorted(counts.items()):
        j = new[u]
        file, first = opened[j]
        if filled[j] - first >= ranked:
            opened[j] = file, first = file + 1, filled[j]
        files.append((u, part, j, file, first))
        filled[j] += n
    files = spark.createDataFrame(files, "__gl_u long, __gl_p int, shard int, __gl_file int, __gl_first long")
    out = in_units(wide if keep_columns else rows).join(F.broadcast(files), (F.col("__gl_unit") == F.col("__gl_u")) & (F.col("__gl_part") == F.col("__gl_p")))
    rank = F.row_number().over(Window.partitionBy("shard", "__gl_file").orderBy(c.quoted(id_col), "text_crc32", "size", "__gl_row"))
    out = out.withColumn("slot", F.col("__gl_first") + rank - 1)
    return out.select(*[c.quoted(x) for x in plain], "size", "text_crc32", "old_shard", "shard", "slot")


def rewrite(placed: DataFrame, path: str) -> list[int]:
    """Write the shards that gain or lose rows, one folder ``shard=<n>`` each, and leave all others alone; returns those shards.

    ``placed`` comes from ``reshard`` with ``keep_columns``.  Readers of the old layout take untouched shards from it and the
    listed ones from ``path``; rows without an id and repeated rows are written like any other.
    """
    moved = placed.filter("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    shards = sorted(r.s for r in moved.collect())  # at most as many as there are shards
    placed.filter(F.col("shard").isin(shards)).write.partitionBy("shard").mode("overwrite").parquet(path)  # lies in files already
    return shards


def read_shards(placed: DataFrame, path: str, shards: list[int]) -> DataFrame:
    """The new layout: ``shards`` from the files at ``path``, the untouched ones from ``placed``."""
    if not shards:
        return placed
    written = placed.sparkSession.read.schema(placed.schema).parquet(path).select(*[c.quoted(x) for x in placed.columns])
    return written.unionByName(placed.filter(~F.col("shard").isin(shards)))


def op9_resharding(spark, sf_dir: str) -> DataFrame:
    """The corpus lies in six shards by id and goes to eight; what is rewritten is read from the rewritten files."""
    placed = reshard(c.table(spark, sf_dir, "documents").select("doc_id", "text"), keep_columns=True)
    path = c.new_folder(spark)
    out = read_shards(placed, path, rewrite(placed, path))
    out = out.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")).withColumn("text_crc32", F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
