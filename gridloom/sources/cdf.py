"""The classic binary format (CDF-1, CDF-2, CDF-5): header codec, and a Spark data source that reads and writes variables.

    spark.dataSource.register(CdfSource)
    spark.read.format("cdf").option("var", "temperature").load(path)

A variable is read in slabs, one Spark partition and one Arrow batch each: boxes of about ``SLAB`` cells, cut along the first
dimension where that is enough and along later ones else; the options ``start`` and ``count`` cut what is read.  (Filters are
not pushed: Spark keeps a reader for all queries of a DataFrame, so one query's filter would cut the next.)  A slab is a strided
view of the mapped file, so only the pages it lies on are touched.  Writers take Arrow batches, order them by offset and write
runs of neighbours at once.

With the option ``runs`` a row is a run of neighbours, not a cell: the coordinates of its first cell and ``v`` as an array, for reads
that of a slab's last dimension.  Writers take runs wherever ``v`` is an array.  That spares Spark a row for each number.

Where cells of other variables lie between (records), a write for each cell would be most of the time.  Cells that are ``dealt`` by
blocks of the file can be written with the option ``blocks``: what lies between near cells of a block is read and written with them.
"""

from __future__ import annotations

import itertools
import os
import struct
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.types import BY_CODE, UNLIMITED, ArrayError, Code, external
from ..plans.catalog import Att, Catalog, Dim, Var

_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12  # fixed values: tags of the header's lists


def sniff(head: bytes) -> str:
    """What a file's first bytes say: CDF-1, CDF-2, CDF-5, HDF5 or unknown (BP files tell by their last bytes: ``sniff_path``)."""
    if head[:3] == b"CDF" and len(head) > 3 and head[3] in (1, 2, 5):
        return f"CDF-{head[3]}"
    at = 0
    while at + 8 <= len(head):
        if head[at : at + 8] == b"\x89HDF\r\n\x1a\n":
            return "HDF5"
        at = 512 if not at else at * 2
    return "unknown"


def sniff_path(path: str) -> str:
    """What a file is, by its head and, for BP files, its foot: three ascending offsets of indexes, then byte order and version."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        kind = sniff(f.read(1 << 16))
        if kind != "unknown" or size < 28:
            return kind
        f.seek(size - 28)
        foot = f.read(28)
    for order in "<>":
        groups, variables, attributes, tail = struct.unpack(order + "QQQI", foot)
        big, version = tail >> 31, tail & 0xFF
        if 0 < groups < variables < attributes < size - 28 and big == (order == ">") and version in (1, 2, 3):
            return "BP"
    return "unknown"


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 4)


def encode_header(c: Catalog) -> bytes:
    wide = c.version == 5
    count = (lambda n: struct.pack(">q", n)) if wide else (lambda n: struct.pack(">I", n))
    begin = (lambda n: struct.pack(">i", n)) if c.version == 1 else (lambda n: struct.pack(">q", n))
    tag = lambda t, items: struct.pack(">i", t if items else 0) + count(len(items))
    name = lambda s: count(len(s.encode())) + _pad(s.encode())

    def values(a: Att) -> bytes:
        if a.xtype == "char":
            raw = a.values.encode() if isinstance(a.values, str) else bytes(a.values)
            return count(len(raw)) + _pad(raw)
        return count(len(a.values)) + _pad(np.array(a.values).astype(external(a.xtype).dtype).tobytes())

    attributes = lambda items: tag(_ATTRIBUTE, items) + b"".join(name(a.name) + struct.pack(">i", external(a.xtype).code) + values(a) for a in items)
    out = b"CDF" + bytes([c.version]) + count(c.numrecs)
    out += tag(_DIMENSION, c.dims) + b"".join(name(d.name) + count(d.size) for d in c.dims)
    out += attributes(c.atts) + tag(_VARIABLE, c.vars)
    for v in c.vars:
        size = c.vsize(v)
        size = size if wide or size <= 2**32 - 4 else 2**32 - 1
        out += name(v.name) + count(len(v.dims)) + b"".join(count(d) for d in v.dims) + attributes(v.atts) + struct.pack(">i", external(v.xtype).code) + count(size) + begin(v.begin)
    return out


class _Reader:
    def __init__(self, data: bytes, strict: bool):
        self.data, self.at, self.strict, self.wide = data, 0, strict, False

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ArrayError(Code.NOTNC, "the header is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(">" + kind, self.take(struct.calcsize(kind)))[0]

    def count(self) -> int:
        n = self.number("q" if self.wide else "I")
        if n < 0:
            raise ArrayError(Code.NOTNC, "negative count")
        return n

    def padded(self, n: int) -> bytes:
        out = self.take(n)
        if self.take(-n % 4).strip(b"\0") and self.strict:
            raise ArrayError(Code.NULLPAD, f"at byte {self.at}")
        return out

    def name(self) -> str:
        try:
            return self.padded(self.count()).decode()
        except UnicodeDecodeError:
            raise ArrayError(Code.NOTNC, "a name is not UTF-8") from None

    def items(self, tag: int, one) -> list:
        got, n = self.number("i"), self.count()
        if got not in (0, tag) or not got and n or n > len(self.data):
            raise ArrayError(Code.NOTNC, f"tag {got} with {n} items, not {tag}")
        return [one() for _ in range(n)]

    def xtype(self, version: int) -> str:
        code = self.number("i")
        if code not in BY_CODE or version != 5 and code > 6:
            raise ArrayError(Code.BADTYPE, f"type {code}")
        return BY_CODE[code].name

    def attribute(self, version: int) -> Att:
        name, xtype = self.name(), self.xtype(version)
        n = self.count()
        raw = self.padded(n * external(xtype).size)
        if xtype == "char":
            return Att(name, xtype, raw.decode("utf-8", "surrogateescape"))
        return Att(name, xtype, np.frombuffer(raw, external(xtype).dtype).tolist())


def decode_header(data: bytes, strict: bool = False) -> Catalog:
    """The catalogue of a file's head; errors for anything that is not one.  ``strict`` also wants null padding and sound begins."""
    r = _Reader(data, strict)
    if r.take(3) != b"CDF" or (version := r.take(1)[0]) not in (1, 2, 5):
        raise ArrayError(Code.NOTNC, "no classic file")
    r.wide = version == 5
    numrecs = r.count()
    dims = r.items(_DIMENSION, lambda: Dim(r.name(), r.count()))
    if sum(d.size == UNLIMITED for d in dims) > 1:
        raise ArrayError(Code.UNLIMIT)
    atts = r.items(_ATTRIBUTE, lambda: r.attribute(version))

    def variable() -> Var:
        name, rank = r.name(), r.count()
        if rank > len(data):
            raise ArrayError(Code.NOTNC, "rank")
        ids = [r.count() for _ in range(rank)]
        if any(d >= len(dims) for d in ids):
            raise ArrayError(Code.BADDIM, name)
        if any(dims[d].size == UNLIMITED for d in ids[1:]):
            raise ArrayError(Code.UNLIMPOS, name)
        own = r.items(_ATTRIBUTE, lambda: r.attribute(version))
        xtype = r.xtype(version)
        r.count()  # the size is computed, never believed
        begin = r.number("i" if version == 1 else "q")
        if begin < 0:
            raise ArrayError(Code.NOTNC, f"{name} begins at {begin}")
        return Var(name, xtype, ids, own, begin=begin)

    c = Catalog(version, dims, r.items(_VARIABLE, variable), atts, numrecs)
    if any(v.begin < r.at for v in c.vars if c.inner(v)):
        raise ArrayError(Code.NOTNC, "a variable begins within the header")
    if strict:
        c.check_sizes()
        c.check_layout()
    return c


def read_header(path: str, strict: bool = False) -> Catalog:
    """Reads chunk by chunk until the header is whole."""
    size, n = os.path.getsize(path), 1 << 18
    while True:
        with open(path, "rb") as f:
            data = f.read(n)
        try:
            return decode_header(data, strict)
        except ArrayError:
            if n >= size:
                raise
            n *= 4


def schema_of(c: Catalog, v: Var, runs: bool = False) -> T.StructType:
    """Coordinates and value of a cell, or of a run of cells (for a variable with dimensions)."""
    meta = {"xtype": v.xtype, "dims": [c.dims[d].name for d in v.dims]}
    return T.StructType([*[T.StructField(f"i{k}", T.LongType(), False) for k in range(len(v.dims))], T.StructField("v", T.ArrayType(external(v.xtype).spark, False) if runs and v.dims else external(v.xtype).spark, True, meta)])


def arrow_values(raw: np.ndarray, xtype: str) -> pa.Array:
    if xtype == "char":
        data, at = np.ascontiguousarray(raw), np.arange(len(raw) + 1, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
    if xtype == "uint64":
        return pa.array(raw.astype(np.uint64)).cast(pa.decimal128(20, 0))
    to = {"byte": np.int8, "short": np.int16, "int": np.int32, "float": np.float32, "double": np.float64, "ubyte": np.int16, "ushort": np.int32, "uint": np.int64, "int64": np.int64}[xtype]
    return pa.array(raw.astype(to))


def raw_values(values: pa.Array, xtype: str) -> np.ndarray:
    """Values without nulls, as the file has them."""
    t = external(xtype)
    if xtype == "char":
        return np.frombuffer(b"".join(x[:1] or b"\0" for x in values.to_pylist()), "S1")
    if xtype == "uint64":
        return values.cast(pa.decimal128(20, 0)).cast(pa.uint64()).to_numpy(zero_copy_only=False).astype(t.dtype)
    return values.to_numpy(zero_copy_only=False).astype(t.dtype)


class Slab(InputPartition):
    """A box of cells: where it begins and ends in each dimension."""

    def __init__(self, lo: tuple[int, ...], hi: tuple[int, ...]):
        self.lo, self.hi = lo, hi


class CdfReader(DataSourceReader):
    SLAB = 1 << 20  # cells of a partition, about

    def __init__(self, path: str, var: str, options: dict):
        self.path, self.catalog = path, read_header(path)
        self.var = self.catalog.var(var)
        self.runs = _flag(options.get("runs")) and bool(self.var.dims)
        shape = self.catalog.shape(self.var)
        numbers = lambda name: [int(x) for x in options[name].split(",")] if options.get(name) else None
        start, count = numbers("start") or [0] * len(shape), numbers("count")
        self.low = [max(0, a) for a in start]
        self.high = [min(n, a + k) for a, k, n in zip(start, count, shape, strict=True)] if count else shape
        self.shape = shape

    def partitions(self):
        size = [max(0, h - a) for a, h in zip(self.low, self.high, strict=True)]
        if not all(size):
            return [Slab((0,) * len(size), (0,) * len(size))]
        inner, k = 1, len(size)
        while k and inner * size[k - 1] <= self.SLAB:  # dimensions from k on lie in a slab whole
            k -= 1
            inner *= size[k]
        if not k:
            return [Slab(tuple(self.low), tuple(self.high))]
        step = max(1, self.SLAB // inner)
        cuts = [[(a, a + 1) for a in range(self.low[j], self.high[j])] for j in range(k - 1)]
        cuts.append([(a, min(a + step, self.high[k - 1])) for a in range(self.low[k - 1], self.high[k - 1], step)])
        rest = [(a, h) for a, h in zip(self.low[k:], self.high[k:], strict=True)]
        return [Slab(*zip(*combination, *rest, strict=True)) for combination in itertools.product(*cuts)]

    def _cells(self, lo: tuple, hi: tuple) -> np.ndarray:
        """The values of a box; what the file is too short for was never written and reads as zeros."""
        c, v, t = self.catalog, self.var, external(self.var.xtype)
        strides = [t.size] * len(lo)
        for k in range(len(lo) - 2, -1, -1):
            strides[k] = strides[k + 1] * self.shape[k + 1]
        if c.is_record(v):
            strides[0] = c.recsize()
        size = [b - a for a, b in zip(lo, hi, strict=True)]
        first = v.begin + sum(a * s for a, s in zip(lo, strides, strict=True))
        span = sum((n - 1) * s for n, s in zip(size, strides, strict=True)) + t.size
        if first + span <= os.path.getsize(self.path):
            return np.ndarray(size, t.dtype, np.memmap(self.path, np.uint8, "r"), first, strides)
        if len(lo) and size[0] > 1:
            half = lo[0] + size[0] // 2
            return np.concatenate([self._cells(lo, (half, *hi[1:])), self._cells((half, *lo[1:]), hi)])
        with open(self.path, "rb") as f:
            f.seek(first)
            return np.ndarray(size, t.dtype, f.read(span).ljust(span, b"\0"), 0, strides)

    def read(self, partition):
        lo, hi = partition.lo, partition.hi
        if any(a >= b for a, b in zip(lo, hi, strict=True)):
            return
        part = self._cells(lo, hi)
        if self.runs:
            wide = part.shape[-1]
            index = np.indices(part.shape[:-1], dtype=np.int64).reshape(len(lo) - 1, part.size // wide)
            coords = [*(pa.array(x + a) for x, a in zip(index, lo, strict=False)), pa.array(np.full(part.size // wide, lo[-1], np.int64))]
            values = arrow_values(np.ascontiguousarray(part).reshape(-1), self.var.xtype)
            ends = pa.array(np.arange(0, part.size + 1, wide, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*coords, pa.ListArray.from_arrays(ends, values)], names=[*[f"i{k}" for k in range(len(lo))], "v"])
            return
        index = np.indices(part.shape, dtype=np.int64).reshape(len(lo), part.size)
        coords = [pa.array(x + a) for x, a in zip(index, lo, strict=True)]
        yield pa.RecordBatch.from_arrays([*coords, arrow_values(np.ascontiguousarray(part).reshape(-1), self.var.xtype)], names=[*[f"i{k}" for k in range(len(lo))], "v"])


def _flag(x) -> bool:
    return str(x or "").lower() in ("true", "1")


class _Written(WriterCommitMessage):
    def __init__(self, most: int):
        self.most = most


#: Bytes of the file that go to one task and are written at once; the largest gap between cells that is read and written with them.
BLOCK, GAP = 1 << 18, 4 << 10


def _strides(c: Catalog, v: Var) -> list[int]:
    """Bytes from an index to the next, by dimension."""
    out = [external(v.xtype).size] * len(v.dims)
    for k in range(len(out) - 2, -1, -1):
        out[k] = out[k + 1] * c.dims[v.dims[k + 1]].size
    if c.is_record(v):
        out[0] = c.recsize()
    return out


def dealt(cells, c: Catalog, v: Var):
    """A DataFrame of cells for the option ``blocks``: those of a block of the file in one task, in the file's order."""
    if not v.dims:
        return cells
    from pyspark.sql import functions as F

    at = sum((F.col(f"i{k}").cast("long") * F.lit(s).cast("long") for k, s in enumerate(_strides(c, v))), F.lit(v.begin).cast("long"))
    return cells.repartition(F.floor(at / F.lit(BLOCK))).sortWithinPartitions(at)


class CdfWriter(DataSourceArrowWriter):
    """Writes one variable of cells into a file that has its header (see ``create``); tasks write at their own offsets.

    Works on folders all executors share.  Null values are left as they are in the file; where a task has a cell twice, the
    later one stays.  The record count is raised when all tasks are done.

    ``blocks``: no other task or process writes between two near cells of one task in the same block, as ``dealt`` sees to it.
    A block is written at once, so an attempt that is repeated writes the same bytes.
    """

    HELD = 1 << 21  # cells that are ordered and written together

    def __init__(self, path: str, var: str, blocks: bool = False):
        self.path, self.catalog = path, read_header(path)
        self.name, self.blocks = var, blocks

    def _flush(self, handle: int, offsets: list[np.ndarray], values: list[np.ndarray], size: int, last: bool = True) -> int:
        """Writes what is held, but for a block that may go on (with ``blocks``, before the ``last``); how many cells stay."""
        if not offsets:
            return 0
        at, raw = np.concatenate(offsets), np.concatenate(values)
        offsets.clear()
        values.clear()
        if (at[1:] <= at[:-1]).any():
            order = np.argsort(at, kind="stable")
            at, raw = at[order], raw[order]
            kept = np.append(at[1:] != at[:-1], True)
            at, raw = at[kept], raw[kept]
        if self.blocks and not last and len(at) and at[0] // BLOCK < at[-1] // BLOCK:
            cut = np.searchsorted(at, at[-1] // BLOCK * BLOCK)
            offsets.append(at[cut:])
            values.append(raw[cut:])
            at, raw = at[:cut], raw[:cut]
        gap = np.diff(at) - size
        starts = np.flatnonzero(np.append(len(at) > 0, (gap > GAP) | (np.diff(at // BLOCK) != 0) if self.blocks else gap != 0))
        data = memoryview(raw.tobytes())
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            first, part = int(at[lo]), data[lo * size : hi * size]
            if (span := int(at[hi - 1]) + size - first) > len(part):
                part = memoryview(self._between(handle, first, span, at[lo:hi] - first, part, size))
            done = 0
            while done < span:
                done += os.pwrite(handle, part[done:], first + done)
        return len(offsets[0]) if offsets else 0

    def _between(self, handle: int, first: int, span: int, at: np.ndarray, part: memoryview, size: int) -> bytes:
        """Cells and what the file has between them."""
        old = b""
        while len(old) < span and (more := os.pread(handle, span - len(old), first + len(old))):
            old += more
        out = np.frombuffer(bytearray(old.ljust(span, b"\0")), np.uint8)
        out[at[:, None] + np.arange(size)] = np.frombuffer(part, np.uint8).reshape(-1, size)
        return out.tobytes()

    def _runs(self, handle: int, coords: list[np.ndarray], strides: list[int], values: pa.Array, v: Var) -> None:
        """Runs of cells: each is written at its first cell's offset, neighbours in the batch at once.  Runs and their values are not null."""
        t = external(v.xtype)
        n = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.full(len(n), v.begin, np.int64)
        for x, s in zip(coords, strides, strict=True):
            at += x.astype(np.int64) * s
        data = memoryview(raw_values(values.flatten(), v.xtype).tobytes())
        begin = np.cumsum(n * t.size) - n * t.size
        cut = np.flatnonzero(np.append(True, at[1:] != at[:-1] + n[:-1] * t.size))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(n)], strict=True):
            done, end = int(begin[lo]), int(begin[hi - 1] + n[hi - 1] * t.size)
            first = int(at[lo]) - done
            while done < end:
                done += os.pwrite(handle, data[done:end], first + done)

    def write(self, batches):
        c, v = self.catalog, self.catalog.var(self.name)
        t, rank, record = external(v.xtype), len(v.dims), c.is_record(v)
        strides = _strides(c, v)
        most, held, offsets, values = 0, 0, [], []
        handle = os.open(self.path, os.O_RDWR if self.blocks else os.O_WRONLY)
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                coords = [batch.column(f"i{k}").to_numpy(zero_copy_only=False) for k in range(rank)]
                most = max(most, int(coords[0].max()) + 1) if record else most
                v_column = batch.column("v")
                if pa.types.is_list(v_column.type) or pa.types.is_large_list(v_column.type):
                    self._runs(handle, coords, strides, v_column, v)
                    continue
                known = v_column.is_valid().to_numpy(zero_copy_only=False)
                at = np.full(batch.num_rows, v.begin, np.int64)
                for x, s in zip(coords, strides, strict=True):
                    at += x.astype(np.int64) * s
                offsets.append(at[known])
                values.append(raw_values(v_column.drop_null(), v.xtype).view(f"V{t.size}"))  # bytes, which no operation swaps
                held += int(known.sum())
                if held >= self.HELD:
                    held = self._flush(handle, offsets, values, t.size, last=False)
            self._flush(handle, offsets, values, t.size)
            os.fsync(handle)
        finally:
            os.close(handle)
        return _Written(most)

    def commit(self, messages):
        most = max([self.catalog.numrecs, *(m.most for m in messages if m)])
        if most > self.catalog.numrecs:
            set_numrecs(self.path, most)

    def abort(self, messages):
        pass


class CdfSource(DataSource):
    """Options: ``path``, ``var``, and for reads ``start`` and ``count`` (comma lists) and ``runs``; for writes ``blocks``."""

    @classmethod
    def name(cls):
        return "cdf"

    def schema(self):
        c = read_header(self.options["path"])
        return schema_of(c, c.var(self.options["var"]), _flag(self.options.get("runs")))

    def reader(self, schema):
        return CdfReader(self.options["path"], self.options["var"], self.options)

    def writer(self, schema, overwrite):
        return CdfWriter(self.options["path"], self.options["var"], _flag(self.options.get("blocks")))


def set_numrecs(path: str, n: int) -> None:
    """Overwrite the record count in place."""
    with open(path, "r+b") as f:
        head = f.read(4)
        if sniff(head)[:3] != "CDF":
            raise ArrayError(Code.NOTNC, path)
        f.seek(4)
        f.write(struct.pack(">q" if head[3] == 5 else ">I", n))


def fill_bytes(v: Var) -> bytes:
    """One fill value of a variable, as the file has it."""
    t, own = external(v.xtype), v.att("_FillValue")
    fill = own.values if own else t.fill
    if t.name == "char":
        return (fill.encode() if isinstance(fill, str) else bytes(fill))[:1] or b"\0"
    return np.array(fill[0] if isinstance(fill, list) else fill).astype(t.dtype).tobytes()


#: Bytes of fill that the driver writes itself, and bytes that one task fills, about.
DRIVER_FILL, TASK_FILL = 8 << 20, 64 << 20


def fills(c: Catalog, first_record: int = 0, fixed: bool = True) -> list[tuple[int, bytes, int]]:
    """What fills a file: (offset, pattern, times).  All record variables share a pattern, that of one record."""
    out = []
    for v in c.vars if fixed else []:
        if not c.is_record(v):
            one, n = fill_bytes(v), c.inner(v)
            each = max(1, min(n, (1 << 16) // len(one)))
            whole, rest = divmod(n, each)
            out.append((v.begin, one * each, whole))
            out.append((v.begin + whole * each * len(one), one * rest + b"\0" * (c.vsize(v) - n * len(one)), 1))
    own = [v for v in c.vars if c.is_record(v)]
    if own and c.numrecs > first_record:
        at, size = min(v.begin for v in own), c.recsize()
        if size <= TASK_FILL:
            record = b"".join((fill_bytes(v) * c.inner(v)).ljust(c.vsize(v) if len(own) > 1 else 0, b"\0") for v in sorted(own, key=lambda v: v.begin))
            each = max(1, min(c.numrecs - first_record, (1 << 16) // max(1, size)))
            whole, rest = divmod(c.numrecs - first_record, each)
            out += [(at + first_record * size, record * each, whole), (at + (first_record + whole * each) * size, record * rest, 1)]
        else:  # a record is more than a task fills: each variable of each record by itself
            for v in own:
                one = fill_bytes(v)
                each = max(1, (1 << 16) // len(one))
                whole, rest = divmod(c.inner(v), each)
                for r in range(first_record, c.numrecs):
                    out += [(v.begin + r * size, one * each, whole), (v.begin + r * size + whole * each * len(one), one * rest, 1)]
    return [x for x in out if x[1] and x[2]]


def _fill(path: str, at: int, pattern: bytes, times: int) -> None:
    each = max(1, (4 << 20) // len(pattern))
    block, handle = pattern * min(each, times), os.open(path, os.O_WRONLY)
    try:
        for k in range(0, times, each):
            data, done = memoryview(block)[: min(each, times - k) * len(pattern)], 0
            while done < len(data):
                done += os.pwrite(handle, data[done:], at + k * len(pattern) + done)
    finally:
        os.close(handle)


def write_fill(path: str, ranges: list[tuple[int, bytes, int]], spark=None) -> None:
    """Write patterns into a file: few bytes here, many by Spark tasks (with ``spark``), each at its own offsets."""
    if spark is None or sum(len(p) * n for _, p, n in ranges) <= DRIVER_FILL:
        for at, pattern, n in ranges:
            _fill(path, at, pattern, n)
        return
    parts = []
    for at, pattern, n in ranges:
        each = max(1, TASK_FILL // len(pattern))
        parts += [(at + k * len(pattern), pattern, min(each, n - k)) for k in range(0, n, each)]

    def run(batches):
        for b in batches:
            for at, pattern, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                _fill(path, at, pattern, n)
            yield b.slice(0, 0)

    rows = spark.createDataFrame(parts, "at long, pattern binary, n long").repartition(min(len(parts), 10_000))
    rows.mapInArrow(run, rows.schema).count()


def create(path: str, c: Catalog, clobber: bool = True, spark=None) -> Catalog:
    """Write a file with a header and all cells filled; written beside the path and renamed.  With ``spark``, tasks fill it."""
    if not clobber and os.path.exists(path):
        raise ArrayError(Code.EXIST, path)
    c.lay_out()
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    ranges = fills(c)
    with os.fdopen(handle, "wb") as f:
        f.write(encode_header(c))
        f.truncate(max([f.tell(), *(at + len(p) * n for at, p, n in ranges)]))
    write_fill(beside, ranges, spark)
    os.replace(beside, path)
    return c


def validate(path: str, repair: bool = False) -> list[str]:
    """What is wrong with a file; ``repair`` zeroes padding that is not null."""
    from ..functions.types import Code as K

    found = []
    try:
        c = read_header(path, strict=True)
    except ArrayError as e:
        found.append(str(e))
        if e.code != K.NULLPAD:
            return found
        c = read_header(path)
        if repair:
            with open(path, "r+b") as f:
                f.write(encode_header(c))
    ends = [v.begin + c.vsize(v) for v in c.vars if not c.is_record(v)]
    ends += [max(v.begin for v in c.vars if c.is_record(v)) + (c.numrecs - 1) * c.recsize()] if c.numrecs and any(map(c.is_record, c.vars)) else []
    if ends and os.path.getsize(path) < max(ends) - 3:
        found.append(f"the file has {os.path.getsize(path)} bytes, fewer than {max(ends)}")
    return found
