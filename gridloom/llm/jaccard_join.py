"""Exact n-gram Jaccard join as a metric-space join: pivots, Voronoi regions, triangle-inequality windows.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric; two documents link when d <= tau = 1 - similarity.

1. *Which shingles are shared.*  A document that links has ceil(s * n) of its n shingles in another document.  Blocks of
   documents send a short key of each distinct shingle once, with its count in the block; buckets add the counts up and
   answer with four bits of document frequency.  A key that meets another by chance only lets more through.
2. *Singleton pivots.*  With the pivot {w} a document lies at 1 - 1/n if it has w, else at 1: its nearest pivots are its own
   shingles.  Ties go to the rarest.  A linking partner misses at most n - ceil(s * n) of the shingles, so it meets the
   document in the region of one of its n - ceil(s * n) + 1 rarest: these are the boundary windows it is replicated to.
   Regions that share a document are merged (connected components of a table of ids and keys, without any shingle
   set), so each set travels once, to its region.
3. *Within a region*, ``join_region`` takes the middles of its groups of near copies as pivots: d(x, p) <= tau links x to p, and
   |d(x, p) - d(y, p)| > tau rules a pair out.  The rest meet by single pivots again, now by frequency in the region: y looks
   into the regions of its boundary windows, only at sizes and places that leave enough shared shingles, and only at documents
   it is not connected to.  Large classes are looked into but do not look, so near copies around a pivot cost one pass.
   A region beyond ``REGION_SHINGLES`` first goes through ``ROUNDS`` rounds that are spread over the cluster: all distances to a
   few pivots are measured in parallel; documents within tau of a pivot are linked to it; of those only the ones whose distance
   window reaches a document outside that ball go on.  A region that is still many times as large falls apart into the regions
   of its single pivots, which it was merged from, if that copies less than blocks do.  What is beyond the bound then is cut
   into blocks, and a task joins two of them: every pair meets, and the number of tasks is known beforehand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: Bytes of a shingle's key that are sent to find the shared ones.
KEY_BYTES = 4
BUCKET_SHINGLES = 1_000_000
#: Shingles of a region that one task joins; larger ones go through pivot rounds, then two blocks at a time.
REGION_SHINGLES = 8_000_000
#: Pivot rounds of a region beyond REGION_SHINGLES.
ROUNDS = 4
#: Regions beyond so many REGION_SHINGLES fall apart into those of their single pivots, where that copies less.
WIDE = 4
#: Pivots of a region in a round.
PIVOTS = 8
#: Documents of a region that are compared without further pivots; a larger class waits for others to look into it.
LEAF = 256


def _least(n, percent: int):
    """ceil(percent / 100 * n): shared shingles a document of n needs at least."""
    return -(-n * percent // 100)


class _Sets:
    """Shingle sets of the documents of a block, in order of id and text."""

    def __init__(self, t: pa.Table, words: int):
        ids, texts = t.column("__gl_id").to_pylist(), t.column("__gl_text").to_pylist()
        texts = [(x or "").encode().lower() for x in texts]  # bytes: A-Z only
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in self.order]
        hashes = c.WordHashes()
        self.sets = []
        for i in self.order:
            w = hashes.of(texts[i].split())
            self.sets.append(np.unique(c.gram_hashes(w, min(words, len(w)))) if len(w) else np.empty(0, np.uint64))
        flat = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        self.distinct, self.counts = np.unique(flat, return_counts=True)

    def bucket(self, n_buckets: int) -> np.ndarray:
        return ((self.distinct >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)


def _send(words: int, n_buckets: int):
    def send(t: pa.Table) -> pa.Table:
        s = _Sets(t, words)
        bucket = s.bucket(n_buckets)
        order = np.argsort(bucket, kind="stable")
        starts = c.runs(bucket[order])
        out = {"bucket": [], "block": [], "keys": [], "counts": []}
        for lo, hi in zip(starts, np.append(starts[1:], len(order)), strict=True) if len(order) else ():
            o = order[lo:hi]
            out["bucket"].append(int(bucket[o[0]]))
            out["keys"].append(c.cut(s.distinct[o], KEY_BYTES))
            out["counts"].append(c.pack(np.minimum(s.counts[o], 255).astype(np.uint8)))
        out["block"] = [t.column("__gl_block")[0].as_py()] * len(out["bucket"])
        return pa.table(out, schema=c.arrow_schema(bucket=pa.int32(), block=pa.int32(), keys=pa.binary(), counts=pa.binary()))

    return send


def _frequencies(t: pa.Table) -> pa.Table:
    """For each key of each block the logarithm of its document frequency, 0 if no other document has it."""
    keys = [c.uncut(x.as_py(), KEY_BYTES) for x in t.column("keys")]
    counts = np.concatenate([c.unpack(x.as_py(), np.uint8) for x in t.column("counts")])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    starts = c.runs(flat[order])
    total = np.add.reduceat(counts[order].astype(np.int64), starts)
    level = np.empty(len(flat), np.uint8)
    level[order] = np.repeat(np.minimum(np.log2(total), 15).astype(np.uint8), np.diff(np.append(starts, len(order))))
    edges = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "levels": pa.array([c.pack(x) for x in np.split(level, edges)], pa.binary())}, schema=_LEVELS)


_LEVELS = c.arrow_schema(block=pa.int32(), bucket=pa.int32(), levels=pa.binary())
_FEATURES = "id long, n long, f1 long, f2 long, pivots array<long>, shingles binary"
_FEATURES_ARROW = c.arrow_schema(id=pa.int64(), n=pa.int64(), f1=pa.int64(), f2=pa.int64(), pivots=pa.list_(pa.int64()), shingles=pa.binary())


def _features(words: int, percent: int, n_buckets: int):
    def features(docs: pa.Table, levels: pa.Table) -> pa.Table:
        s = _Sets(docs, words)
        bucket = s.bucket(n_buckets)
        order = np.argsort(bucket, kind="stable")
        level = np.zeros(len(order), np.uint8)
        starts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b, x in zip(levels.column("bucket").to_pylist(), levels.column("levels"), strict=True):
            level[order[starts[b] : starts[b + 1]]] = c.unpack(x.as_py(), np.uint8)
        out = {k: [] for k in ("id", "n", "f1", "f2", "pivots", "shingles")}
        seen = set()
        for d, x in enumerate(s.sets):
            n = len(x)
            f1, f2 = (int(c.mix(x).sum(dtype=np.uint64).view(np.int64)), int(c.mix(x ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))) if n else (0, 0)
            pivots = shingles = None
            if n and s.ids[d] is not None and (f1, f2, n) not in seen:
                own = level[np.searchsorted(s.distinct, x)]
                if (own > 0).sum() >= _least(n, percent):
                    rarest = np.lexsort((x, own))[: n - _least(n, percent) + 1]
                    pivots, shingles = x[rarest[own[rarest] > 0]].view(np.int64), x.tobytes()
                    seen.add((f1, f2, n))
            for k, v in zip(out, (s.ids[d], n, f1, f2, pivots, shingles), strict=True):
                out[k].append(v)
        return pa.table(out, schema=_FEATURES_ARROW)

    return features


# --- joins within a region ----------------------------------------------------------------------


class _Region:
    """Sets of a region as one array of shingles, numbered by their frequency in the region, and the documents' classes."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.n = np.array([len(x) for x in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        _, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        base = np.repeat(np.arange(len(sets)) * len(order), self.n)
        self.flat = rank[flat]
        del flat
        self.flat += base
        self.flat.sort()  # each document's rarest first
        self.flat -= base
        self.df = counts[order]
        self.mark = np.zeros(len(order), bool)
        self.percent, self.tau = percent, 1 - percent / 100
        self.label = np.arange(len(sets))
        self.members = {}

    def union(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return
        mine, other = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(mine) < len(other):
            a, mine, other = b, other, mine
        self.label[other] = a
        mine += other
        self.members[a] = mine

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of i with each of others."""
        mine = self.flat[self.starts[i] : self.starts[i + 1]]
        self.mark[mine] = True
        n = self.n[others]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[others] - (ends - n), n)
        out = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), ends - n)
        self.mark[mine] = False
        return out

    def distance(self, i: int, others: np.ndarray) -> np.ndarray:
        k = self.shared(i, others)
        return 1 - k / (self.n[i] + self.n[others] - k)

    def test(self, i: int, others: np.ndarray) -> None:
        """Link i with those of others within tau; ever larger portions, as a link can connect many of the rest."""
        most = 64
        while len(others := others[self.label[others] != self.label[i]]):
            now, others = others[:most], others[most:]
            most *= 2
            k = self.shared(i, now)
            for j in now[100 * k >= self.percent * (self.n[i] + self.n[now] - k)]:
                self.union(i, j)


_EPS = 1e-9


def join_region(sets: list[np.ndarray], percent: int = 80) -> np.ndarray:
    """For each set the number of the first set that links lead to; exact."""
    r, members = _Region(sets, percent), np.arange(len(sets))
    if len(sets) <= LEAF:
        _leaf(r, members)
    else:
        _windows(r, _balls(r, members))
    _, first, inverse = np.unique(r.label, return_index=True, return_inverse=True)
    return first[inverse]


def _leaf(r: _Region, members: np.ndarray) -> None:
    """Each member in turn is a pivot for those after it that are not connected to it yet."""
    members = members[np.argsort(r.n[members], kind="stable")]
    for k, i in enumerate(members[:-1]):
        rest = members[k + 1 :]
        r.test(i, rest[100 * r.n[i] >= r.percent * r.n[rest]])  # sizes: |x & y| <= |x|


def _balls(r: _Region, members: np.ndarray) -> np.ndarray:
    """Distances to document pivots, a row each; what lies within tau of a pivot is linked to it.

    A pivot is the document of the most frequent shingles (the middle of a group of near copies) among those far from all
    pivots before it.
    """
    middle = np.add.reduceat(r.df[r.flat], r.starts[:-1]) / r.n
    least, rows = np.full(len(members), np.inf), []
    while len(rows) < PIVOTS * 2 and (free := least > 3 * r.tau).any():
        pivot = int(np.where(free, middle, -1).argmax())
        d = r.distance(pivot, members)
        r.test(pivot, members[d <= r.tau + _EPS])
        rows.append(d)
        least = np.minimum(least, d)
    return np.array(rows)


def _windows(r: _Region, d: np.ndarray) -> None:
    """Links between different classes, by the region's single pivots and the windows of its document pivots.

    Two documents that link meet in the region of one of their boundary windows, the n - ceil(s * n) + 1 rarest shingles.  At
    the first that they share, in places p of x and q of y, they share |x| - p and |y| - q shingles at most: so y looks only
    at the |x| which that leaves.  Classes of more than LEAF documents do not look but are found; such classes meet each other
    after the rest.
    """
    need = -(-r.n * r.percent // 100)
    length = r.n - need + 1
    ends = np.cumsum(length)
    place = np.arange(ends[-1]) - np.repeat(ends - length, length)
    doc = np.repeat(np.arange(len(r.n)), length)
    token = r.flat[r.starts[doc] + place]
    kept = r.df[token] > 1
    place, doc, token = place[kept], doc[kept], token[kept]
    wide = int(r.n.max()) + 1

    def meet(lookers: np.ndarray, found: np.ndarray) -> None:
        f = np.flatnonzero(found[doc])
        key = token[f] * wide + r.n[doc[f]]
        order = np.argsort(key, kind="stable")
        key, f = key[order], f[order]
        of, at = doc[f], place[f]
        edge = np.searchsorted(doc, [lookers, lookers + 1])
        for y, lo, hi in zip(lookers, *edge, strict=True):
            n, q, t = int(r.n[y]), place[lo:hi], token[lo:hi]
            # 100 k >= s (|x| + |y| - k) and k <= |y| - q
            most = np.minimum(((100 + r.percent) * (n - q)) // r.percent - n, wide - 1)
            low, up = np.searchsorted(key, t * wide - (-n * r.percent // 100)), np.searchsorted(key, t * wide + np.maximum(most, 0), side="right")
            size = np.maximum(up - low, 0)
            if not size.any():
                continue
            e = np.cumsum(size)
            i = np.arange(e[-1]) + np.repeat(low - (e - size), size)
            x = of[i]
            i = i[r.label[x] != r.label[y]]
            x = of[i]
            i = i[(100 + r.percent) * (r.n[x] - at[i]) >= r.percent * (r.n[x] + n)]
            x, times = np.unique(of[i], return_counts=True)
            x = x[np.argsort(-times, kind="stable")]
            if len(x):
                r.test(y, x[(np.abs(d[:, x] - d[:, [y]]) <= r.tau + _EPS).all(axis=0)])

    label, inverse, counts = np.unique(r.label, return_inverse=True, return_counts=True)
    large = counts[inverse] > LEAF
    meet(np.flatnonzero(~large), np.ones(len(large), bool))
    before = np.zeros(len(large), bool)
    for k in np.flatnonzero(counts > LEAF):
        if before.any():
            meet(np.flatnonzero(inverse == k), before)
        before |= inverse == k


def _joined(percent: int):
    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")]
        ids = t.column("id").to_numpy()
        return pa.table({"a": ids, "b": ids[join_region(sets, percent)]}, schema=c.arrow_schema(a=pa.int64(), b=pa.int64()))

    return joined


# --- regions over the cluster -------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a table of links: ``node`` and ``component``, its least node.

    Alternates large and small stars until nothing changes; every step is a join and an aggregation over the links, cut off
    from its lineage by a reliable checkpoint.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = c.checkpointed(e)
    before = None
    while True:
        # large star: a node's larger neighbours point to its least neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("w"), "m")
        large = both.join(low, both.u == low.w).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node's smaller neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, large.u == low.w).select("v", "m", "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        e = c.checkpointed(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def _ball_rounds(sets: DataFrame, percent: int, region_shingles: int, rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """Take documents out of regions beyond ``region_shingles`` by rounds of PIVOTS pivots each, spread over the cluster.

    ``sets``: region, id, n, shingles.  Returns what is left, and links found.  A document within tau of a pivot is linked to
    it.  It is done if that is its own set, or if its window [d - tau, d + tau] reaches no document beyond tau of the pivot:
    all its partners are linked to the pivot then.  Nothing comes to the driver; a table with a row for each large region is
    broadcast only while it is small.
    """
    tau, links, done = 1 - percent / 100, [], []

    @F.pandas_udf("array<double>")
    def far(shingles: pd.Series, pivots: pd.Series) -> pd.Series:
        out = []
        for x, ps in zip(shingles, pivots, strict=True):
            x, row = np.frombuffer(x, np.uint64), []
            for y in ps:
                y = np.frombuffer(y, np.uint64)
                k = len(np.intersect1d(x, y, assume_unique=True))
                row.append(1 - k / (len(x) + len(y) - k))
            out.append(row)
        return pd.Series(out)

    for turn in range(rounds):
        chosen = [F.min_by("id", F.xxhash64("id", F.lit(turn * PIVOTS + k))) for k in range(PIVOTS)]
        size = sets.groupBy("region").agg(F.sum("n").alias("all"), F.array_distinct(F.array(*chosen)).alias("ids")).filter(F.col("all") > region_shingles)
        large = c.checkpointed(size.select("region", "ids"))
        n_large = large.count()
        if not n_large:
            break
        hint = F.broadcast if n_large <= 1000 else lambda x: x
        sets = c.materialize(sets)
        done.append(sets.join(hint(large), "region", "left_anti"))
        inside = sets.join(hint(large), "region")
        at = inside.filter(F.array_contains("ids", F.col("id"))).groupBy("region", "id").agg(F.min("shingles").alias("shingles"))
        at = at.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("id", "shingles"))).alias("p"))  # PIVOTS sets at most
        at = c.materialize(at.select("region", F.col("p.id").alias("at"), F.col("p.shingles").alias("sets")))
        measured = c.materialize(inside.drop("ids").join(hint(at), "region").withColumn("d", far("shingles", "sets")).drop("sets"))
        near = measured.select("id", F.explode(F.arrays_zip("at", "d")).alias("x")).filter(F.col("x.d") <= tau + _EPS)
        links.append(near.select(F.col("id").alias("a"), F.col("x.at").alias("b")).filter("a <> b"))
        beyond = [F.min(F.when(F.get("d", F.lit(k)) > tau + _EPS, F.get("d", F.lit(k)))) for k in range(PIVOTS)]
        reach = measured.groupBy("region").agg(F.array(*beyond).alias("reach"))
        inner = F.zip_with("d", "reach", lambda d, r: F.coalesce((d == 0) | (d <= tau + _EPS) & (r.isNull() | (d < r - tau - _EPS)), F.lit(False)))
        still = measured.join(hint(reach), "region").filter(~F.exists(inner, lambda x: x))
        sets = still.select("region", "id", "n", "shingles")
    for x in done:
        sets = sets.unionByName(x)
    return sets, links


def _parts(n: Column, region_shingles: int) -> Column:
    """Blocks of a region of ``n`` shingles, of which any two fit ``region_shingles``; 1 for a region that fits."""
    return F.when(n > region_shingles, F.ceil(2 * n / F.lit(region_shingles))).otherwise(1)


def _by_pivot(sets: DataFrame, least: DataFrame, region_shingles: int) -> DataFrame | None:
    """Regions beyond WIDE times ``region_shingles`` by their single pivots: each document in the region of each of its boundary
    windows that another document has.  None where no region is that large.  Two documents that link share one of these pivots.

    A region where this would copy more shingles than its pairs of blocks do stays whole: a wide group of near copies has the
    same pivots throughout.
    """
    size = sets.groupBy("region").agg(F.sum("n").alias("all")).filter(F.col("all") > WIDE * region_shingles)
    large = c.checkpointed(size)
    n_large = large.count()
    if not n_large:
        return None
    hint = F.broadcast if n_large <= 1000 else lambda x: x
    sets = c.materialize(sets)
    inside = sets.join(hint(large.select("region")), "region", "left_semi")
    keys = least.select(F.col("rep").alias("id"), F.explode("pivots").alias("key")).join(inside.select("region", "id", "n"), "id").distinct()
    shared = keys.groupBy("region", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")).filter("m > 1")
    copied = lambda n: n * F.greatest(_parts(n, region_shingles) - 1, F.lit(1))
    costs = shared.groupBy("region").agg(F.sum(copied(F.col("all"))).alias("cost"))
    apart = c.checkpointed(large.join(costs, "region", "left").filter(F.coalesce("cost", F.lit(0)) < copied(F.col("all"))).select("region"))
    keys = keys.join(shared.select("region", "key"), ["region", "key"]).join(hint(apart), "region", "left_semi").select("id", "key")
    cut = inside.join(hint(apart), "region", "left_semi").join(keys, "id").select(F.col("key").alias("region"), "id", "n", "shingles")
    return sets.join(hint(apart), "region", "left_anti").unionByName(cut)


def _block_pairs(sets: DataFrame, region_shingles: int) -> DataFrame:
    """``sets`` with a column ``part``: a region beyond ``region_shingles`` is cut into blocks by id, and each part holds two of
    them, so that every two documents meet in a part and no part is much larger than ``region_shingles``."""
    size = sets.groupBy("region").agg(F.sum("n").alias("all")).filter(F.col("all") > region_shingles)
    large = c.checkpointed(size.select("region", _parts(F.col("all"), region_shingles).cast("int").alias("blocks")))
    n_large = large.count()
    if not n_large:
        return sets.withColumn("part", F.lit(0).cast("long"))
    hint = F.broadcast if n_large <= 1000 else lambda x: x
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    parts = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own")), lambda b: F.least(b, "own").cast("long") * F.col("blocks") + F.greatest(b, "own"))
    return sets.join(hint(large), "region", "left").withColumn("own", own).select("region", "id", "n", "shingles", F.explode(F.coalesce(parts, F.array(F.lit(0).cast("long")))).alias("part"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """Components of documents by n-gram Jaccard links: one row for each row of ``docs``.

    Returns ``id_col``, ``n_shingles`` and ``component_id``, the least id that links lead to.  Two documents link when
    100 * |x & y| >= percent * |x | y| over their sets of distinct ``words``-word shingles (A-Z lower-cased; a shorter
    document is one shingle).

    Null, empty and wordless texts have no shingles and are their own component.  Rows that share an id are one node: links
    of any of them count for all.  Rows without an id have a null component and link with nothing.  An empty table
    gives an empty result.
    """
    base = docs.select(c.quoted(id_col).cast("long").alias("__gl_id"), c.quoted(text_col).alias("__gl_text"))
    _, n_bytes = c.text_bytes(base, "__gl_text")
    n_blocks, n_buckets = c.blocks_for(n_bytes), c.buckets_for(n_bytes, BUCKET_SHINGLES)
    salt = F.xxhash64("__gl_id", F.when(F.col("__gl_id").isNull(), F.col("__gl_text")))
    blocked = base.select("__gl_id", "__gl_text", F.pmod(salt, F.lit(n_blocks)).cast("int").alias("__gl_block"))
    sent = blocked.groupBy("__gl_block").applyInArrow(_send(words, n_buckets), "bucket int, block int, keys binary, counts binary")
    levels = sent.groupBy("bucket").applyInArrow(_frequencies, "block int, bucket int, levels binary")
    features = c.materialize(blocked.groupBy("__gl_block").cogroup(levels.groupBy("block")).applyInArrow(_features(words, percent, n_buckets), _FEATURES))
    # One representative of each set; the others have its id as their component's member.
    kind = ["f1", "f2", "n"]
    able = features.filter("pivots is not null")
    least = able.groupBy(*kind).agg(F.min(F.struct("id", "pivots")).alias("rep")).select(*kind, F.col("rep.id").alias("rep"), F.col("rep.pivots").alias("pivots"))
    least = c.checkpointed(least)
    keys = least.select("rep", F.explode("pivots").alias("key"))
    meets = keys.groupBy("key").agg(F.min("rep").alias("m"), F.max("rep").alias("x")).filter("m <> x").select("key", "m")
    meets = keys.join(meets, "key").filter("rep <> m").select(F.col("rep").alias("a"), F.col("m").alias("b"))
    region = c.checkpointed(components(meets))
    region = region.union(region.select(F.col("component").alias("node"), "component").distinct().filter("node = component")).distinct()
    sets = features.filter("shingles is not null").select("id", "n", "shingles", "f1", "f2")
    sets = sets.join(region, sets.id == region.node).select(F.col("component").alias("region"), "id", "n", "shingles")
    sets, links = _ball_rounds(sets, percent, region_shingles, ROUNDS)
    apart = _by_pivot(sets, least, region_shingles)
    sets = _block_pairs(sets if apart is None else apart, region_shingles)
    found = sets.select("region", "part", "id", "shingles").groupBy("region", "part").applyInArrow(_joined(percent), "a long, b long").filter("a <> b")
    for x in links:
        found = found.union(x)
    # Rows that share an id, and equal sets, tie their classes together.
    same_id = least.join(features.filter("n > 0 and id is not null").select("id", *kind).distinct(), kind).select(F.col("rep").alias("a"), F.col("id").alias("b")).filter("a <> b")
    classes = components(found.union(same_id))
    nodes = features.select("id", "n").join(classes, features.id == classes.node, "left")
    return nodes.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which the id is the least of its component, all columns as they were; rows without an id stay."""
    joined = jaccard_join(docs, id_col, text_col, words, percent)
    gone = joined.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gl_id")).distinct()
    return c.without(docs, gone, id_col)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(c.table(spark, sf_dir, "documents"))


def shingle_sql(words: int = 5, source: str = "documents") -> str:
    w = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda v: v <> '')"
    return f"""w as (select doc_id, {w} as ws from {source}),
s as (select distinct doc_id, array_to_string(ws[p:p + {words - 1}], ' ') as k from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {words - 2}, 2))) as p from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
x as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (k) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from x join n m on m.doc_id = a join n o on o.doc_id = b where 100 * k >= 80 * (m.n + o.n - k)),
e as (select a, b from l union select b, a from l),
r(doc_id, c) as (select distinct a, a from e union select e.b, r.c from r join e on e.a = r.doc_id),
g as (select doc_id, min(c) as c from r group by doc_id)"""


SQL = f"""
with recursive {shingle_sql()}
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(g.c, w.doc_id) as component_id from w left join n using (doc_id) left join g using (doc_id)"""
