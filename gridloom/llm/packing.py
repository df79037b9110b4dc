"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens.  What decides a packing is how many pieces have each length, a table
of at most ``capacity`` rows however large the corpus; the plan is made from it on the driver.  The reduction fixes bins that
some best packing contains: a piece nothing else fits with; a pair that fills a sequence; a piece with its largest partner
where no two smaller ones together can do better.  What is left goes, largest first, to the fullest sequence it fits; if that
takes more sequences than its tokens need, each sequence is instead filled best by subset sums, and the better plan stays.
Bins of the same content are one pattern with a count, so the plan stays small; a piece finds its place from its rank among the
pieces of its length, and ranks are counted in salted parts, so a length that a third of all pieces have is no hot spot.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c


#: Pieces of one length that are ranked together, about, and parts of a length at least.
RANKED, LEAST_SALTS = 100_000, 8


@lru_cache(maxsize=4)
def encoder(path: str, ranks: tuple[str, str] | None = None):
    """Text to the ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, added tokens in the text included.

    ``ranks``: a .tiktoken file of the same vocabulary and its pattern; it gives the same ids for less, and is taken for the
    texts without an added token.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    plain = lambda text: exact.encode(text, add_special_tokens=False).ids
    if not ranks:
        return plain
    import tiktoken

    with open(ranks[0], "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    fast = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=table, special_tokens={}).encode_ordinary
    added = [t.content for t in exact.get_added_tokens_decoder().values()]
    return lambda text: plain(text) if any(x in text for x in added) else fast(text)


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: all full but the first, which takes the rest."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer: str, ranks: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The token pieces of each row: id_col, piece, start, length, ids_crc32 and, on demand, ids.

    Null text is empty; every document ends with ``end_id``, so it has a piece.  Ids may be null or repeat.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def tokenize(batches):
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # bounded output
                part = batch.slice(at, 500)
                out = {f.name: [] for f in fields}
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    start = 0
                    for k, n in enumerate(cut_lengths(len(ids), capacity)):
                        own = ids[start : start + n]
                        for name, value in zip(out, (key, k, start, n, zlib.crc32(own.tobytes()), own.astype(np.int32)), strict=False):
                            out[name].append(value)
                        start += n
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return docs.select(c.quoted(id_col).alias(id_col), c.quoted(text_col).alias("__gl_text")).mapInArrow(tokenize, schema)


class Plan:
    """Bins by pattern: ``bins`` lists (count, ((length, times), ...)); made from a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.bins: list[tuple[int, tuple[tuple[int, int], ...]]] = []
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        self.fixed = self._reduce(left)
        filled = self._best_fit(left)
        if sum(n for n, _ in filled) > -(-int(left @ np.arange(capacity + 1)) // capacity):  # more than the tokens alone need
            refilled = self._refill(left.copy())
            filled = min(filled, refilled, key=lambda bins: sum(n for n, _ in bins))
        self.bins += filled

    def _fix(self, left: np.ndarray, *lengths: int) -> int:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        n = min(int(left[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                left[x] -= n * k
            self.bins.append((n, tuple(need.items())))
        return n

    def _reduce(self, left: np.ndarray) -> int:
        """Fix dominating bins, from the longest piece down; returns how many."""
        fixed = 0
        for s in range(self.capacity, 0, -1):
            while left[s]:
                left[s] -= 1  # partners of one piece of length s
                present = np.flatnonzero(left[: self.capacity - s + 1])
                room = self.capacity - s
                low: list[int] = []
                for x in present[:3]:
                    low += [int(x)] * min(3, int(left[x]))
                low = low[:3]
                left[s] += 1
                if not len(present):
                    n = self._fix(left, s)
                    fixed += n
                    continue
                k = int(present[-1])
                if k == room or sum(low[:2]) > room or len(low) < 2 or (sum(low) > room or len(low) < 3) and k >= self._best_pair(left, s, room, present):
                    n = self._fix(left, s, k)
                    if not n:  # the last piece of a length that is its own partner
                        break
                    fixed += n
                else:
                    break
        return fixed

    @staticmethod
    def _best_pair(left: np.ndarray, s: int, room: int, present: np.ndarray) -> int:
        """The largest sum of two further pieces that fits."""
        best, i, j = 0, 0, len(present) - 1
        while i <= j:
            a, b = int(present[i]), int(present[j])
            if a + b > room:
                j -= 1
                continue
            if i < j or left[a] - (a == s) >= 2:
                best = max(best, a + b)
            i += 1
        return best

    def _refill(self, left: np.ndarray) -> list:
        """Bin by bin: the longest piece left, and with it the pieces, longer ones first, that leave the least room."""
        out = []
        for s in range(self.capacity, 0, -1):
            while left[s]:
                left[s] -= 1
                room, reach, layers = self.capacity - s, 1, []
                for x in np.flatnonzero(left[: room + 1])[::-1].tolist():
                    layers.append((x, reach))
                    for _ in range(min(int(left[x]), room // x)):
                        reach |= reach << x
                    if reach >> room & 1:
                        break
                left[s] += 1
                target = (reach & ((1 << room + 1) - 1)).bit_length() - 1
                pattern = [(s, 1)]
                for x, before in reversed(layers):
                    k = 0
                    while not before >> target & 1:
                        target, k = target - x, k + 1
                    if k:
                        pattern = [(s, k + 1), *pattern[1:]] if x == s else [*pattern, (x, k)]
                n = min(int(left[x]) // k for x, k in pattern)
                for x, k in pattern:
                    left[x] -= n * k
                out.append((n, tuple(pattern)))
        return out

    def _best_fit(self, left: np.ndarray) -> list:
        """Longest first, each to the fullest open bin that it fits."""
        open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [[count, pattern], ...]
        for s in range(self.capacity, 0, -1):
            n = int(left[s])
            moved = []
            for room in sorted(r for r in open_bins if r >= s):
                while n and open_bins[room]:
                    group = open_bins[room][-1]
                    q = room // s
                    m = min(group[0], n // q)
                    if m:
                        moved.append((room - q * s, [m, (*group[1], (s, q))]))
                        n -= m * q
                    else:
                        m, q, n = 1, n, 0
                        moved.append((room - q * s, [1, (*group[1], (s, q))]))
                    group[0] -= m
                    if not group[0]:
                        open_bins[room].pop()
                if not n:
                    break
            q = self.capacity // s
            if n >= q:
                moved.append((self.capacity - q * s, [n // q, ((s, q),)]))
            if n % q:
                moved.append((self.capacity - n % q * s, [1, ((s, n % q),)]))
            for room, group in moved:
                open_bins[room].append(group)
        return [(n, pattern) for groups in open_bins.values() for n, pattern in groups]

    def places(self) -> dict[int, np.ndarray]:
        """By length, in order of rank: first rank, first sequence, times in a sequence, offset."""
        out, ranks, sequence = defaultdict(list), defaultdict(int), 0
        for n, pattern in self.bins:
            offset = 0
            for s, q in pattern:
                out[s].append((ranks[s], sequence, q, offset))
                ranks[s] += n * q
                offset += s * q
            sequence += n
        self.n_sequences = sequence
        return {s: np.array(x, np.int64) for s, x in out.items()}


def pack(parts: DataFrame, capacity: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` (dense from 0) and ``offset`` to each row, so that the rows of a sequence lie there gapless from 0.

    ``parts`` has lengths from 1 to ``capacity``; rows of a null or other length are an error.  All other columns stay; columns
    of the two names are replaced.  ``parts`` is read three times, so pass it materialised if it is dear.  Rows that are equal in
    ``order`` share no place.  An empty table gives an empty result.
    """
    spark = parts.sparkSession
    lengths = parts.groupBy(c.quoted(length_col).alias("x")).count().collect()  # at most capacity rows
    total = {}
    for length, n in lengths:
        if length is None or not 1 <= length <= capacity:
            raise ValueError(f"a piece has length {length}; the capacity is {capacity}")
        total[int(length)] = n
    # A length is ranked in as many parts as it has pieces for, so a length that most pieces have is no hot spot.
    salts = np.zeros(capacity + 1, np.int64)
    for length, n in total.items():
        salts[length] = max(LEAST_SALTS, -(-n // RANKED))
    first = np.cumsum(salts) - salts  # of a length's parts in one list
    table = spark.createDataFrame([(x, int(salts[x])) for x in total], "__gl_length long, __gl_salts long")
    salted = parts.join(F.broadcast(table), c.quoted(length_col).cast("long") == F.col("__gl_length"))
    salted = salted.withColumn("__gl_salt", F.pmod(F.xxhash64(*map(c.quoted, order)), F.col("__gl_salts")).cast("int"))
    counts = np.zeros(int(salts.sum()), np.int64)
    for length, s, n in salted.groupBy("__gl_length", "__gl_salt").count().collect():  # a row for RANKED pieces, and few for each length
        counts[first[length] + s] = n
    before = np.cumsum(counts) - counts
    before -= np.repeat(before[np.minimum(first, max(0, len(before) - 1))], salts) if len(before) else 0  # within the length
    places = Plan(total, capacity).places()
    held = spark.sparkContext.broadcast((first, before, places))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, salt: pd.Series, number: pd.Series) -> pd.DataFrame:
        first, before, places = held.value
        length, salt = length.to_numpy(), salt.to_numpy()
        rank = before[first[length] + salt] + number.to_numpy() - 1
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for s in np.unique(length):
            own, table = length == s, places[int(s)]
            row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
            within = rank[own] - row[:, 0]
            sequence[own], offset[own] = row[:, 1] + within // row[:, 2], row[:, 3] + within % row[:, 2] * s
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("__gl_length", "__gl_salt").orderBy(*map(c.quoted, order)))
    placed = salted.withColumn("__gl_number", number).withColumn("__gl_place", place("__gl_length", "__gl_salt", "__gl_number"))
    return placed.select(*[c.quoted(x) for x in parts.columns if x not in ("sequence_id", "offset")], "__gl_place.sequence_id", "__gl_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, ranks: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """``pieces`` and ``pack``: each document is tokenized once and its pieces are written to the shared folder."""
    cut = c.materialize(pieces(docs, tokenizer, ranks, id_col, text_col, capacity, with_ids=with_ids))
    return pack(cut, capacity, order=(id_col, "piece", "ids_crc32"))


def public_byte_bpe() -> tuple[str, tuple[str, str]]:
    """The public byte-level tokenizer, and the ranks and pattern of the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(c.table(spark, sf_dir, "documents").select("doc_id", "text"), *public_byte_bpe())
