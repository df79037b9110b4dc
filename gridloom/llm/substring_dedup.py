"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

The corpus, in order of id, is cut into blocks; every block is a reference for the blocks after it and, document by
document, for itself.  A block is indexed by its phrases (runs of ``window`` words).  The indexes meet in buckets by
phrase hash, where each block learns for its own distinct phrases the earliest block and offset that has them.  Each
document is then parsed greedily: at a word whose phrase is indexed a factor starts and runs on while the source runs
on; elsewhere the word is a literal.  A factor end may cut a longer repeat in two, so the phrases that straddle it are
looked up as well, and what they add joins the span.  Words within spans are removed.

What moves: each block sends a distinct phrase once (``KEY_BYTES`` of its hash and about a byte of offset), so a
passage found in a third of all rows counts once a block; answers name only repeated phrases.  The key together with
the bucket, an independent hash, has 64 + log2(buckets) bits: among the phrases of 100 TB less than one pair is expected to
meet by chance.  Blocks and buckets both grow with a root of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: Bytes of a phrase's hash that are sent; the bucket has the other bits.
KEY_BYTES = 8
#: Phrases a bucket holds on average, at least.
BUCKET_PHRASES = 1_000_000


class _Block:
    """The documents of one block in order of id, with their words and phrase hashes.  Without an id: last, not indexed."""

    def __init__(self, t: pa.Table, window: int, hashes: c.WordHashes):
        ids, texts = t.column("__gl_id").to_pylist(), t.column("__gl_text").to_pylist()
        texts = [(x or "").encode() for x in texts]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in self.order]
        self.words = [texts[i].split() for i in self.order]
        n = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(n)])
        flat = np.concatenate([hashes.of(w) for w in self.words]) if len(n) else np.empty(0, np.uint64)
        self.flat, self.window = flat, window
        # phrases that stay within a document that has an id
        ok = np.zeros(len(flat), bool)
        for d, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            if self.ids[d] is not None and b - a >= window:
                ok[a : b - window + 1] = True
        self.at = np.flatnonzero(ok)  # word offset of each phrase in the block
        self.key = c.gram_hashes(flat, window, 1)[self.at] if len(self.at) else np.empty(0, np.uint64)

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase the number, among self.at, of its first occurrence in the block; and which are first."""
        order = np.argsort(self.key, kind="stable")
        starts = c.runs(self.key[order])
        rep = np.empty(len(order), np.int64)
        rep[order] = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
        return rep, np.sort(order[starts])

    def bucket(self, which: np.ndarray, n_buckets: int) -> np.ndarray:
        return (c.gram_hashes(self.flat, self.window, 2)[self.at[which]] % np.uint64(n_buckets)).astype(np.int64)


def _index(window: int, n_buckets: int):
    def index(t: pa.Table) -> pa.Table:
        b = _Block(t, window, c.WordHashes())
        out = {"bucket": [], "block": [], "keys": [], "offsets": []}
        if len(b.key):
            _, reps = b.first()
            bucket = b.bucket(reps, n_buckets)
            order = np.argsort(bucket, kind="stable")
            reps, bucket = reps[order], bucket[order]
            starts = c.runs(bucket)
            for lo, hi in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
                out["bucket"].append(int(bucket[lo]))
                out["keys"].append(c.cut(b.key[reps[lo:hi]], KEY_BYTES))
                out["offsets"].append(c.pack_deltas(b.at[reps[lo:hi]]))
            out["block"] = [t.column("__gl_block")[0].as_py()] * len(out["bucket"])
        return pa.table(out, schema=c.arrow_schema(bucket=pa.int32(), block=pa.int32(), keys=pa.binary(), offsets=pa.binary()))

    return index


def _meet(t: pa.Table) -> pa.Table:
    """Of one bucket: for each block's phrases that an earlier block has too, the earliest block and its offset."""
    t = t.sort_by("block")
    blocks = t.column("block").to_numpy()
    keys = [c.uncut(x.as_py(), KEY_BYTES) for x in t.column("keys")]
    sizes = np.array([len(k) for k in keys])
    keys = np.concatenate(keys)
    offsets = np.concatenate([c.unpack_deltas(x.as_py()) for x in t.column("offsets")])
    order = np.argsort(keys, kind="stable")
    starts = c.runs(keys[order])
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    del order, keys
    row = np.repeat(np.arange(len(sizes)), sizes)
    found = np.flatnonzero(first != np.arange(len(first)))
    out = {"block": [], "own": [], "source": [], "shift": []}
    edges = np.searchsorted(row[found], np.arange(len(sizes) + 1))
    for r in range(len(sizes)):
        f = found[edges[r] : edges[r + 1]]
        if len(f):
            src = first[f]
            out["block"].append(int(blocks[r]))
            out["own"].append(c.pack_deltas(offsets[f]))
            out["source"].append(c.pack(blocks[row[src]].astype(np.int32)))
            out["shift"].append(c.pack(offsets[src] - offsets[f]))
    return pa.table(out, schema=_ANSWER)


_ANSWER = c.arrow_schema(block=pa.int32(), own=pa.binary(), source=pa.binary(), shift=pa.binary())


def _factors(at: np.ndarray, source: np.ndarray, shift: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse of one document: (first word, words, source block, source offset) of each factor.

    ``at``: the offsets of its indexed phrases.  A run goes on while the next phrase is the next of the same source.
    """
    out, covered = [], -1
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(shift) != 0)) + 1
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(at)), strict=True):
        start, end = int(at[lo]), int(at[hi - 1]) + window
        if end > covered:  # phrases that straddle the end of the factor before begin within it
            out.append((start, end - start, int(source[lo]), int(at[lo] + shift[lo])))
            covered = end
    return out


def _parse(window: int, schema: pa.Schema, spans: bool):
    def parse(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        block = docs.column("__gl_block")[0].as_py()
        b = _Block(docs, window, c.WordHashes())
        n = len(b.key)
        source, shift = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if n:
            rep, _ = b.first()
            doc = np.searchsorted(b.starts, b.at, side="right") - 1
            ids = np.array([0 if x is None else x for x in b.ids], np.int64)
            local = ids[doc[rep]] < ids[doc]
            own = np.full(len(b.flat), -1, np.int64)  # by offset: the answer's source block
            own_at = np.zeros(len(b.flat), np.int64)
            for r in range(answers.num_rows):
                at = c.unpack_deltas(answers.column("own")[r].as_py())
                own[at] = c.unpack(answers.column("source")[r].as_py(), np.int32)
                own_at[at] = at + c.unpack(answers.column("shift")[r].as_py(), np.int64)
            first_at = b.at[rep]
            source = np.where(own[first_at] >= 0, own[first_at], np.where(local, block, -1))
            shift = np.where(own[first_at] >= 0, own_at[first_at], first_at) - b.at
        hit = np.flatnonzero(source >= 0)
        edges = np.searchsorted(b.at[hit], b.starts)
        out = {"n_words": [], "n_removed": [], "kept": [], "spans": []}
        for d, words in enumerate(b.words):
            lo, hi = b.starts[d], b.starts[d + 1]
            h = hit[edges[d] : edges[d + 1]]
            factors = [(s - int(lo), k, x, y) for s, k, x, y in _factors(b.at[h], source[h], shift[h], window)] if len(h) else []
            mask = np.ones(hi - lo, bool)
            for start, length, _, _ in factors:
                mask[start : start + length] = False
            left = int(mask.sum())
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - left)
            kept = words if left == len(words) else [words[i] for i in np.flatnonzero(mask)]
            out["kept"].append(b" ".join(kept).decode())
            out["spans"].append(factors if spans else [])
        back = docs.take(pa.array(b.order))
        columns = {
            "__gl_id": back.column("__gl_id"), "__gl_text": back.column("__gl_text"), "__gl_rest": back.column("__gl_rest"),
            "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_text": pa.array(out["kept"], pa.string()),
            "spans": pa.array([[dict(zip(("start", "length", "block", "offset"), s, strict=True)) for s in x] for x in out["spans"]], schema.field("spans").type),
        }
        return pa.table([columns[f.name].cast(f.type) if not pa.types.is_nested(f.type) else columns[f.name] for f in schema], schema=schema)

    return parse


def _blocked(docs: DataFrame, n_blocks: int, step: int) -> DataFrame:
    """Adds __gl_block, ascending with __gl_id; equal ids share a block.  Long documents weigh as many as they are long."""
    bounds: list[int] = []
    if n_blocks > 1:
        weight = F.explode(F.sequence(F.lit(0), (F.coalesce(F.octet_length("__gl_text"), F.lit(0)) / step).cast("int")))
        row = (
            docs.filter("__gl_id is not null").select("__gl_id", weight)
            .agg(F.percentile_approx("__gl_id", [i / n_blocks for i in range(1, n_blocks)], max(10_000, 8 * n_blocks))).first()
        )
        bounds = sorted(set(row[0] or []))
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def block_of(ids):  # the ids alone go to Python
        import pandas as pd

        known = ids.fillna(0).astype("int64").to_numpy()
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(edges, known, side="left")).astype("int32"))

    return docs.withColumn("__gl_block", block_of("__gl_id"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, keep_columns: bool = False, spans: bool = True) -> DataFrame:
    """Remove every word in a run of ``window`` words that also starts in a document of a smaller id.

    Runs are judged on the input.  Returns, for each row of ``docs``: the id, ``n_words``, ``n_removed``, ``kept_text``
    (kept words joined by one space) and ``spans`` (start word, words, and the reference block and word offset in it that
    the factor repeats); with ``keep_columns`` also the text and, in a struct ``rest``, all other columns.

    Null or empty text has no words.  Rows that share an id never remove from each other; each is returned.  Rows without
    an id are returned untouched and are no source.  An empty table gives an empty result.  Ids are integers.
    """
    spark = docs.sparkSession
    rest = c.rest_of(docs, [id_col, text_col]) if keep_columns else []
    base = docs.select(
        c.quoted(id_col).cast("long").alias("__gl_id"), c.quoted(text_col).alias("__gl_text"),
        (F.struct(*[c.quoted(x) for x in rest]) if rest else F.lit(None).cast("int")).alias("__gl_rest"),
    )
    n_rows, n_bytes = c.text_bytes(base, "__gl_text")
    n_blocks = c.blocks_for(n_bytes)
    n_buckets = c.buckets_for(n_bytes, BUCKET_PHRASES)
    step = max(1, n_bytes // max(1, n_rows))
    blocked = _blocked(base, n_blocks if n_rows else 1, step)
    phrases = blocked.groupBy("__gl_block").applyInArrow(_index(window, n_buckets), "bucket int, block int, keys binary, offsets binary")
    answers = phrases.groupBy("bucket").applyInArrow(_meet, "block int, own binary, source binary, shift binary")
    span = "array<struct<start: long, length: long, block: int, offset: long>>"
    out = spark.createDataFrame([], "__gl_id long").schema
    fields = [out["__gl_id"]]
    if keep_columns:
        fields += [base.schema["__gl_text"], base.schema["__gl_rest"]]
    from pyspark.sql import types as T

    fields += T._parse_datatype_string(f"n_words long, n_removed long, kept_text string, spans {span}").fields
    struct = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = blocked.groupBy("__gl_block").cogroup(answers.groupBy("block")).applyInArrow(_parse(window, to_arrow_schema(struct), spans), struct)
    names = {"__gl_id": id_col, "__gl_text": text_col, "__gl_rest": "rest"}
    return parsed.select(*[F.col(f.name).alias(names.get(f.name, f.name)) for f in fields])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(c.table(spark, sf_dir, "documents"), spans=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda v: v <> '')"
SQL = f"""
with w as (select doc_id, {_WORDS} as ws from documents),
g as (select doc_id, p, min(doc_id) over (partition by k) as m from (select doc_id, p, array_to_string(ws[p:p + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from w))),
x as (select distinct doc_id, p + o as p from g, (select unnest(range(13)) as o) where m < doc_id),
u as (select doc_id, unnest(ws) as v, unnest(range(1, len(ws) + 1)) as p from w),
k as (select u.doc_id, string_agg(v, ' ' order by u.p) as kept, count(*) as n from u anti join x on x.doc_id = u.doc_id and x.p = u.p group by u.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from w left join k using (doc_id)"""
