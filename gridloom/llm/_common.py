"""Helpers shared by the text operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: \x20 and \x09-\x0D, as ``bytes.split`` has it.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees; a folder of our own only where none is set and all runs in one process (local tests)."""
    if set_by_cluster := spark.conf.get("spark.checkpoint.dir", None):
        return set_by_cluster.rstrip("/")
    own = spark.conf.get("gridloom.shared.dir", None)
    if not own:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("gridloom.shared.dir", own)
    return own


#: Folders that this session has written and not deleted.
_folders: list[str] = []


def new_folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; the result has no lineage to recompute.

    The folder stays until ``discard``, as what is read from it may be used at any time.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, keep: int = 0, least: int = 0) -> None:
    """Delete the folders written after the first ``least``, but for the last ``keep``: nothing may read them any more."""
    end = len(_folders) - keep
    for path in _folders[least:end]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _folders[least:end]


def folders() -> int:
    """How many folders there are, for ``discard``."""
    return len(_folders)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small tables that an iteration rereads."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def without(docs: DataFrame, gone: DataFrame, id_col: str, most: int = 2_000_000) -> DataFrame:
    """``docs`` less the rows whose id is in ``gone`` (a column __gl_id); at most ``most`` ids are broadcast, more are shuffled."""
    gone = materialize(gone)
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return docs.join(gone, quoted(id_col) == F.col("__gl_id"), "left_anti")


def text_bytes(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a column, in one narrow scan."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()
    return int(row[0]), int(row[1])


def hash_sample(df: DataFrame, key: Column, n: int, ties: list) -> DataFrame:
    """About ``n`` rows and never more: those of the least hashes of ``key``, ties by ``ties``; the same ones at every run.

    A bound on the hash leaves about 2n rows before any are sent to one task, however large the table.  ``key`` should tell
    rows apart: rows of one key come together, cut at ``n``; the least key always comes.
    """
    hashed = df.withColumn("__gl_h", F.xxhash64(key))
    total, least = hashed.agg(F.count(F.lit(1)), F.min("__gl_h")).first()
    if total > 2 * n:
        hashed = hashed.filter(F.col("__gl_h") <= max(least, int(2 * n / total * 2.0**64) - (1 << 63)))
    return hashed.orderBy("__gl_h", *ties).limit(n).drop("__gl_h")


#: Up to so many bytes of text, blocks and buckets have their least size.
GROWS_FROM = 16 << 30


def growth(n_bytes: int) -> float:
    """By what factor blocks and buckets are larger than the least: a root of the input, so that a block's entry in a bucket
    shrinks with the root only; 16 at most, which a task of 2 GB holds."""
    return min(16.0, max(1.0, math.sqrt(n_bytes / GROWS_FROM)))


def blocks_for(n_bytes: int, target: int = 4 << 20, least: int = 48) -> int:
    """How many blocks of about ``target`` bytes times ``growth``; small inputs still get enough to keep a cluster busy."""
    return max(least, math.ceil(n_bytes / (target * growth(n_bytes))))


def buckets_for(n_bytes: int, items: int = 1_000_000, least: int = 64) -> int:
    """How many buckets of about ``items`` words times ``growth``."""
    return max(least, int(n_bytes / 6 / (items * growth(n_bytes))))


# --- words and their hashes, in numpy -----------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Word bytes to a 64-bit hash; forgets all when it holds ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k, c in enumerate(_odd(seed * 1000 + n, n)):
        out += words[k : k + m] * c
    return mix(out)


def pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def pack_deltas(x: np.ndarray) -> bytes:
    """Compressed differences of an ascending array; one byte each where they fit."""
    d = np.diff(x.astype(np.int64), prepend=0)
    wide = d > 254
    return pack(np.concatenate([np.where(wide, 255, d).astype(np.uint8)])) + b"|" + pack(d[wide])


def unpack_deltas(b: bytes) -> np.ndarray:
    z = zlib.decompressobj()
    d = np.frombuffer(z.decompress(b), np.uint8).astype(np.int64)
    d[d == 255] = np.frombuffer(zlib.decompress(z.unused_data[1:]), np.int64)
    return np.cumsum(d)


def cut(x: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of each 64-bit value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def uncut(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def arrow_schema(**columns) -> pa.Schema:
    return pa.schema(list(columns.items()))


def words_of(text: Column) -> Column:
    """The words of a text as an array, on the JVM; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def rest_of(df: DataFrame, taken: list[str]) -> list[str]:
    return [c for c in df.columns if c not in taken]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
