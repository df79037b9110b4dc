"""A dataset: catalogue and one table of cells a variable, with define and data mode, blocking and deferred access.

Every access is one method with ``dtype`` for the memory type; ``collective`` only checks the mode, the plan is the same.
"""

from __future__ import annotations

import os
import shutil
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert as cv
from ..functions.types import GLOBAL, UNLIMITED, ArrayError, Code, allowed, checked_name, external
from ..operators import hyperslab, update
from .catalog import Att, Catalog, Var

if TYPE_CHECKING:
    from ..streaming.records import WriteLog

ALL, ALL_GETS, ALL_PUTS = -1, -2, -3
#: Hints that a dataset knows, with their defaults; the first two name arguments of ``enddef``.
HINTS = {"nc_var_align_size": "512", "nc_record_align_size": "4", "nc_burst_buf": "disable", "nc_burst_buf_dirname": "", "nc_burst_buf_flush_buffer_size": "0", "nc_num_subfiles": "0"}
_ALIGN = {"nc_var_align_size": "v_align", "nc_record_align_size": "r_align"}
#: Environment variable of hints, name=value separated by ";".
HINTS_VARIABLE = "GRIDLOOM_HINTS"
#: Back ends by what a file is; a reason where there is none.
DRIVERS: dict[str, object] = {"HDF5": "HDF5 files need a library that is not here", "BP": "BP files need a library that is not here"}
_open: list[Dataset] = []
_default_version = 1


def set_default_format(version: int) -> int:
    global _default_version
    if version not in (1, 2, 5):
        raise ArrayError(Code.INVAL, str(version))
    old, _default_version = _default_version, version
    return old


def inq_default_format() -> int:
    return _default_version


def register_driver(kind: str, opener) -> None:
    """``opener(spark, path, write)`` opens files of a kind, as ``sniff_path`` names it."""
    DRIVERS[kind] = opener


def inq_libvers() -> str:
    from .. import __version__

    return __version__


def inq_files_opened() -> list[str | None]:
    return [d.path for d in _open]


def delete(path: str) -> None:
    if not os.path.exists(path):
        raise ArrayError(Code.NOENT, path)
    os.remove(path)


class Dataset:
    """``create`` starts in define mode, ``open`` in data mode."""

    def __init__(self, spark: SparkSession, catalog: Catalog, path: str | None, writable: bool, defining: bool, hints: dict[str, str] | None = None):
        self.spark, self.catalog, self.path = spark, catalog, path
        self.writable, self.defining, self.independent = writable, defining, False
        self.cells: dict[str, DataFrame] = {}
        self.fill_mode = False
        self._saved: Catalog | None = None
        self._new = defining
        self._requests: dict[int, dict] = {}
        self._ids = {"put": 0, "get": 1}
        self._buffer: int | None = None
        self.put_bytes = self.get_bytes = 0
        self._unwritten: set[str] = set()  # variables without a cell
        self._slabs: dict[str, DataFrame] = {}  # the file's cells as they were read: in its order, a part of it each task
        self._on_file: set[str] = set()  # variables whose cells are the file's: boxes are cut in the reader
        self._in_place = False  # the file has this layout: writes go to their ranges
        self._patches: list[tuple[str, DataFrame]] = []  # for the file, in order
        self._records_on_file = 0
        self.hints = dict(hints or {})
        self._log: WriteLog | None = None
        if self.hint("nc_burst_buf") == "enable" and writable:
            from ..streaming.records import WriteLog

            self._log = WriteLog(spark, self._beside("log", self.hint("nc_burst_buf_dirname")), int(self.hint("nc_burst_buf_flush_buffer_size")))
        _open.append(self)

    def hint(self, name: str) -> str:
        """The environment's hint, else the caller's, else the default."""
        told = dict(x.split("=", 1) for x in os.environ.get(HINTS_VARIABLE, "").split(";") if "=" in x)
        return told.get(name, self.hints.get(name, HINTS.get(name, "")))

    def inq_file_info(self) -> dict[str, str]:
        """All hints in effect."""
        return {name: self.hint(name) for name in sorted({*HINTS, *self.hints})}

    def _beside(self, what: str, folder: str = "") -> str:
        """A folder beside the file (or in ``folder``), which all executors see as they see the file."""
        if not self.path and not folder:
            raise ArrayError(Code.INVAL, "a dataset without a file needs a folder")
        name = os.path.basename(self.path or "dataset")
        return os.path.join(folder or os.path.dirname(os.path.abspath(self.path)), f".{name}.{what}-{uuid.uuid4().hex}")

    # files

    @classmethod
    def create(cls, spark, path: str | None = None, version: int | None = None, clobber: bool = True, hints: dict[str, str] | None = None) -> Dataset:
        version = version or _default_version
        if version not in (1, 2, 5):
            raise ArrayError(Code.INVAL_CMODE, str(version))
        if path and not clobber and os.path.exists(path):
            raise ArrayError(Code.EXIST, path)
        return cls(spark, Catalog(version), path, True, True, hints)

    @classmethod
    def open(cls, spark, path: str, write: bool = False, hints: dict[str, str] | None = None) -> Dataset:
        from ..sources.cdf import CdfSource, read_header, sniff_path

        if not os.path.exists(path):
            raise ArrayError(Code.NOENT, path)
        kind = sniff_path(path)
        if kind in DRIVERS:
            if isinstance(DRIVERS[kind], str):
                raise ArrayError(Code.NOTSUPPORT, DRIVERS[kind])
            return DRIVERS[kind](spark, path, write)
        if kind == "unknown":
            raise ArrayError(Code.NOTNC, path)
        spark.dataSource.register(CdfSource)
        out = cls(spark, read_header(path), path, write, False, hints)
        out._from_file()
        return out

    def _from_file(self) -> None:
        """All cells are those of the file."""
        for v in self.catalog.vars:
            self.cells[v.name] = self.spark.read.format("cdf").option("path", self.path).option("var", v.name).load()
            self._slabs[v.name] = self.cells[v.name]
            self._on_file.add(v.name)
        self._unwritten.clear()
        self._in_place, self._records_on_file = True, self.catalog.numrecs
        self._header = self._encoded()

    def _encoded(self) -> bytes:
        from ..sources.cdf import encode_header

        return encode_header(self.catalog)

    def close(self) -> None:
        """Writes a new file, or the changed ranges of an old one.  Pending requests are dropped, and reported."""
        if self.defining:
            self.enddef()
        self._write()
        if self._log:
            shutil.rmtree(self._log.path, ignore_errors=True)
        if self in _open:
            _open.remove(self)
        if self._requests:
            self._requests.clear()
            raise ArrayError(Code.PENDING)

    def _write(self) -> None:
        self._flush_log()
        if not (self.path and self.writable):
            return
        if not self._in_place:
            self.save(self.path)
            self._from_file()
        elif self._patches or self._encoded() != self._header:
            self._patch()

    def _patch(self) -> None:
        """Write what was put since the file was written, and nothing else, where it belongs.

        The new cells are written to a folder beside the file first, as they may be computed from the file.  New records are filled
        before; if the job fails half-way, the record count still is the old one.
        """
        from ..sources.cdf import dealt, fills, write_fill

        folder, stored = self._beside("patch"), []
        try:
            for k, (name, cells) in enumerate(self._patches):
                cells.write.parquet(f"{folder}/{k}")
                stored.append((name, self.spark.read.schema(cells.schema).parquet(f"{folder}/{k}")))
            before = self.catalog.numrecs
            write_fill(self.path, fills(self.catalog, self._records_on_file, fixed=False), self.spark)
            self.catalog.numrecs = self._records_on_file
            with open(self.path, "r+b") as f:  # renames and attributes, in the room they have
                f.write(self._encoded())
            self.catalog.numrecs = before
            for name, cells in stored:
                dealt(cells, self.catalog, self.catalog.var(name)).write.format("cdf").mode("append").option("path", self.path).option("var", name).option("blocks", "true").save()
            from ..sources.cdf import set_numrecs

            set_numrecs(self.path, before)
            with open(self.path, "rb+") as f:
                os.fsync(f.fileno())
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        self._patches = []
        self._from_file()

    def abort(self) -> None:
        """A new file is gone; a redefinition is undone."""
        self._requests.clear()
        self._patches = []
        if self in _open:
            _open.remove(self)
        if self._new and not self._in_place and self.path and os.path.exists(self.path):
            os.remove(self.path)
        elif self._saved:
            self.catalog, self._saved = self._saved, None
        self.defining = False

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.abort() if kind else self.close()

    def save(self, path: str) -> None:
        """Header and cells to a classic file; every variable in one job, each task at its own offsets."""
        from ..sources.cdf import CdfSource, create, dealt

        self.spark.dataSource.register(CdfSource)
        target = f"{path}.writing"
        create(target, self.catalog, spark=self.spark)
        for v in self.catalog.vars:
            cells = self.cells[v.name]
            if all(cells is not x for x in self._slabs.values()):
                cells = dealt(cells, self.catalog, v)
            cells.write.format("cdf").mode("append").option("path", target).option("var", v.name).option("blocks", "true").save()
        os.replace(target, path)

    def sync_numrecs(self) -> int:
        """Agrees on the record count."""
        counts = [self.cells[v.name].agg(F.max("i0")).first()[0] for v in self.catalog.vars if self.catalog.is_record(v) and v.name not in self._on_file]
        self.catalog.numrecs = max([self.catalog.numrecs, *(x + 1 for x in counts if x is not None)])
        return self.catalog.numrecs

    def sync(self) -> int:
        """Agrees on the record count, and makes all that was put durable in the file, if there is one."""
        if self.defining:
            raise ArrayError(Code.INDEFINE)
        self._flush_log()
        self.sync_numrecs()
        self._write()
        return self.catalog.numrecs

    flush = sync

    # definition

    def _define(self) -> None:
        if not self.writable:
            raise ArrayError(Code.PERM)
        if not self.defining:
            raise ArrayError(Code.NOTINDEFINE)

    def def_dim(self, name: str, size: int = UNLIMITED) -> int:
        self._define()
        return self.catalog.def_dim(name, size)

    def def_var(self, name: str, xtype: str, dims: list) -> int:
        from ..sources.cdf import schema_of

        self._define()
        out = self.catalog.def_var(name, xtype, dims, no_fill=not self.fill_mode)
        v = self.catalog.vars[out]
        self.cells[v.name] = self.spark.createDataFrame([], schema_of(self.catalog, v))
        self._unwritten.add(v.name)
        return out

    def redef(self) -> None:
        if not self.writable:
            raise ArrayError(Code.PERM)
        if self.defining:
            raise ArrayError(Code.INDEFINE)
        self._flush_log()
        self._saved, self.defining = self.catalog.copy(), True

    def enddef(self, **align) -> None:
        """Lays the file out, and fills variables that are new and have filling on.

        Alignment by the environment's hints, else the caller's hints, else the arguments, else the defaults.  A new layout of an
        old file is written as a new file beside it when the dataset is closed or synchronised.
        """
        self._define()
        told = {x.split("=", 1)[0] for x in os.environ.get(HINTS_VARIABLE, "").split(";")} | set(self.hints)
        align |= {argument: int(self.hint(name)) for name, argument in _ALIGN.items() if name in told}
        self.catalog.lay_out(**align)
        if self._saved and (self._in_place or self._patches):
            begins = lambda c: [(v.name, v.xtype, v.begin) for v in c.vars]
            if begins(self._saved) != begins(self.catalog):  # the file's cells move
                self._in_place, self._patches = False, []
                self._on_file.clear()
        old = {v.name for v in self._saved.vars} if self._saved else set()
        self.defining, self._saved = False, None
        for v in self.catalog.vars:
            if v.name not in old and not v.no_fill and (not self.catalog.is_record(v) or self.catalog.numrecs):
                self.cells[v.name] = self.filled(v.name)
                self._unwritten.discard(v.name)

    def set_fill(self, on: bool) -> bool:
        self._define()
        old, self.fill_mode = self.fill_mode, on
        for v in self.catalog.vars:
            v.no_fill = not on
        return old

    def def_var_fill(self, var, no_fill: bool, value=None) -> None:
        self._define()
        v = self.catalog.var(var)
        v.no_fill = no_fill
        if value is not None:
            self.put_att("_FillValue", value, v.name, v.xtype)

    def rename_dim(self, old: str, new: str) -> None:
        self._rename(self.catalog.dims, self.catalog.dim(old), new)

    def rename_var(self, old: str, new: str) -> None:
        self._on_file.discard(old)
        self._patches = [(new if name == old else name, cells) for name, cells in self._patches]
        k = self.catalog.vars.index(self.catalog.var(old))
        self._rename(self.catalog.vars, k, new)
        self.cells[self.catalog.vars[k].name] = self.cells.pop(old)
        self._unwritten.discard(old)

    def rename_att(self, old: str, new: str, var=None) -> None:
        atts = self.catalog.holder(var)
        self._rename(atts, atts.index(self._att(old, var)), new)

    def _rename(self, items: list, k: int, new: str) -> None:
        new = checked_name(new)
        if any(x.name == new for x in items):
            raise ArrayError(Code.NAMEINUSE, new)
        if not self.defining and len(new.encode()) > len(items[k].name.encode()):
            raise ArrayError(Code.NOTINDEFINE, "a longer name")
        items[k].name = new
        self.catalog.renamed()

    def _att(self, name: str, var=None) -> Att:
        for a in self.catalog.holder(var):
            if a.name == name:
                return a
        raise ArrayError(Code.NOTATT, name)

    def put_att(self, name: str, value, var=None, xtype: str | None = None) -> int:
        """Returns how many values were out of range; those are stored as fill."""
        if not self.writable:
            raise ArrayError(Code.PERM)
        name = checked_name(name)
        values = value if isinstance(value, str) else list(value) if isinstance(value, (list, tuple)) else [value]
        xtype = xtype or ("char" if isinstance(values, str) else "double" if any(isinstance(x, float) for x in values) else "int")
        t = allowed(xtype, self.catalog.version)
        if (xtype == "char") != isinstance(values, str):
            raise ArrayError(Code.CHAR, name)
        if name == "_FillValue" and var not in (None, GLOBAL):
            v = self.catalog.var(var)
            if v.xtype != xtype:
                raise ArrayError(Code.BADTYPE, name)
            if len(values) != 1:
                raise ArrayError(Code.INVAL, name)
            if not self._new and (not self.defining or self._saved and any(x.name == v.name for x in self._saved.vars)):
                raise ArrayError(Code.LATEFILL, name)
        errors = 0
        if xtype != "char":
            good = [t.low <= x <= t.high or x != x for x in values]
            errors = good.count(False)
            values = [(float(x) if xtype in ("float", "double") else int(x)) if ok else t.fill for x, ok in zip(values, good, strict=True)]
        atts = self.catalog.holder(var)
        new = Att(name, xtype, values)
        for k, a in enumerate(atts):
            if a.name == name:
                room = lambda a: -(-len(a.values.encode() if isinstance(a.values, str) else a.values) * external(a.xtype).size // 4)
                if not self.defining and room(new) > room(a):
                    raise ArrayError(Code.NOTINDEFINE, name)
                atts[k] = new
                return errors
        self._define()
        atts.append(new)
        return errors

    def get_att(self, name: str, var=None, dtype: str | None = None):
        a = self._att(name, var)
        if dtype is None or dtype == a.xtype:
            return a.values
        if "char" in (dtype, a.xtype):
            raise ArrayError(Code.CHAR, name)
        t = external(dtype)
        return [(float(x) if dtype in ("float", "double") else int(x)) if t.low <= x <= t.high else t.fill for x in a.values]

    def copy_att(self, name: str, var, other: Dataset, other_var) -> None:
        a = self._att(name, var)
        other.put_att(name, a.values, other_var, a.xtype)

    def del_att(self, name: str, var=None) -> None:
        self._define()
        self.catalog.holder(var).remove(self._att(name, var))

    # inquiry

    def inq(self) -> dict:
        c = self.catalog
        record = sum(map(c.is_record, c.vars))
        unlimited = next((k for k, d in enumerate(c.dims) if d.size == UNLIMITED), -1)
        return {"ndims": len(c.dims), "nvars": len(c.vars), "natts": len(c.atts), "unlimdim": unlimited, "num_rec_vars": record, "num_fix_vars": len(c.vars) - record, "version": c.version, "path": self.path, "header_size": c.header_length(), "header_extent": min((v.begin for v in c.vars), default=c.header_length()), "recsize": c.recsize(), "numrecs": c.numrecs, "nreqs": len(self._requests), "put_size": self.put_bytes, "get_size": self.get_bytes, "buffer_size": self._buffer, "buffer_usage": self._used()}

    def inq_dim(self, dim) -> tuple[str, int]:
        d = self.catalog.dims[self.catalog.dim(dim) if isinstance(dim, str) else dim]
        return d.name, self.catalog.numrecs if d.size == UNLIMITED else d.size

    def inq_var(self, var) -> dict:
        v = self.catalog.var(var)
        return {"name": v.name, "xtype": v.xtype, "ndims": len(v.dims), "dims": [self.catalog.dims[d].name for d in v.dims], "natts": len(v.atts), "offset": v.begin, "no_fill": v.no_fill, "fill": self._fill(v), "shape": self.catalog.shape(v)}

    def inq_att(self, name: str, var=None) -> dict:
        a = self._att(name, var)
        return {"xtype": a.xtype, "len": len(a.values), "attnum": self.catalog.holder(var).index(a)}

    def dims(self) -> DataFrame:
        return self.spark.createDataFrame([(k, d.name, d.size, d.size == UNLIMITED) for k, d in enumerate(self.catalog.dims)], "dimid int, name string, size long, unlimited boolean")

    def vars(self) -> DataFrame:
        c = self.catalog
        return self.spark.createDataFrame([(k, v.name, v.xtype, len(v.dims), c.is_record(v), c.vsize(v), v.begin) for k, v in enumerate(c.vars)], "varid int, name string, xtype string, ndims int, is_rec boolean, len long, begin long")

    def atts(self) -> DataFrame:
        held = [(GLOBAL, self.catalog.atts), *[(k, v.atts) for k, v in enumerate(self.catalog.vars)]]
        rows = [(k, n, a.name, a.xtype, len(a.values), a.values if isinstance(a.values, str) else " ".join(map(str, a.values))) for k, atts in held for n, a in enumerate(atts)]
        return self.spark.createDataFrame(rows, "varid int, attnum int, name string, xtype string, n int, value string")

    # access

    def begin_indep_data(self) -> None:
        if self.defining:
            raise ArrayError(Code.INDEFINE)
        self.independent = True

    def end_indep_data(self) -> None:
        if not self.independent:
            raise ArrayError(Code.NOTINDEP)
        self.independent = False
        self.sync_numrecs()

    def _fill(self, v: Var):
        own = v.att("_FillValue")
        return (own.values[0] if not isinstance(own.values, str) else own.values.encode()) if own else external(v.xtype).fill

    def _checked(self, var, dtype, write: bool, start, count, stride, collective: bool | None) -> Var:
        if write and not self.writable:
            raise ArrayError(Code.PERM)
        if self.defining:
            raise ArrayError(Code.INDEFINE)
        if collective is not None and collective == self.independent:
            raise ArrayError(Code.INDEP if collective else Code.NOTINDEP)
        v = self.catalog.var(var)
        if dtype and (dtype == "char") != (v.xtype == "char"):
            raise ArrayError(Code.CHAR, v.name)
        if start is not None:
            hyperslab.validate(self.catalog.shape(v), start, count, stride, record=self.catalog.is_record(v), write=write, version=self.catalog.version)
        return v

    def get(self, var, start=None, count=None, stride=None, imap=None, dtype: str | None = None, collective: bool | None = None) -> DataFrame:
        """var1 (start alone, as a count of ones), var (nothing), vara, vars and varm, by what is given."""
        if start is not None and count is None and stride is None and imap is None:
            count = [1] * len(start)
        v = self._checked(var, dtype, False, start, count, stride, collective)
        self._flush_log()
        df = self.cells[v.name]
        if start is not None and v.dims:
            if v.name in self._on_file:
                span = [(c - 1) * (stride[k] if stride else 1) + 1 if c else 0 for k, c in enumerate(count)]
                df = self.spark.read.format("cdf").option("path", self.path).option("var", v.name).option("start", ",".join(map(str, start))).option("count", ",".join(map(str, span))).load()
            df = hyperslab.get_varm(df, start, count, stride, imap) if imap is not None else hyperslab.get_vars(df, start, count, stride)
        self.get_bytes += self._bytes(v, count)
        if dtype and dtype != v.xtype:
            source = cv.unwrap_uchar(F.col("v")) if dtype == "ubyte" and v.xtype == "byte" and self.catalog.version != 5 else cv.convert(F.col("v"), v.xtype, dtype)
            df = df.withColumn("v", source)
        return df

    def _bytes(self, v: Var, count) -> int:
        """Bytes of an access, as its box says."""
        out = external(v.xtype).size
        for n in count if count is not None else self.catalog.shape(v):
            out *= n
        return out

    def get_varn(self, var, boxes: list[tuple], dtype: str | None = None) -> DataFrame:
        v = self.catalog.var(var)
        for start, count in boxes:
            self._checked(var, dtype, False, start, count or [1] * len(start), None, None)
        self._flush_log()
        df = hyperslab.get_varn(self.cells[v.name], boxes)
        return df.withColumn("v", cv.convert(F.col("v"), v.xtype, dtype)) if dtype else df

    def mget(self, requests: dict) -> DataFrame:
        return hyperslab.mget({name: self.get(name, **how) for name, how in requests.items()})

    def _written(self, v: Var, cells: DataFrame, dtype: str | None) -> DataFrame:
        on = [f"i{k}" for k in range(len(v.dims))]
        value = F.col("v")
        if dtype and dtype != v.xtype:
            value = cv.wrap_uchar(value) if dtype == "ubyte" and v.xtype == "byte" and self.catalog.version != 5 else cv.convert(value, dtype, v.xtype, cv.fill_of(v.xtype, cv.fill_literal(external(v.xtype)) if v.att("_FillValue") is None else self._fill(v)))
        return cells.select(*on, value.cast(external(v.xtype).spark).alias("v"))

    def put(self, var, cells: DataFrame, start=None, count=None, stride=None, imap=None, dtype: str | None = None, collective: bool | None = None) -> None:
        """Writes cells (coordinates and v), or with ``imap`` the caller's memory (address and v) to the box's cells.

        With a box, a cell outside it fails the job that computes the cells (EDGE).  Cells of the box that are not given stay.
        """
        if start is not None and count is None and stride is None:
            count = [1] * len(start)
        v = self._checked(var, dtype, True, start, count, stride, collective)
        rank = len(v.dims)
        if imap is not None:
            if start is None:
                raise ArrayError(Code.INVALCOORDS, "a map needs a box")
            cells = hyperslab.from_memory(cells, start, count, stride, imap) if rank else cells.select("v")
        new = self._written(v, cells, dtype)
        self.put_bytes += self._bytes(v, count)
        boxed = start is not None and rank > 0
        if boxed:
            outside = F.raise_error(F.concat(F.lit("EDGE (-57): a cell outside the box: "), F.to_json(F.struct(*[f"i{k}" for k in range(rank)]))))
            # an empty box asks for nothing, whatever the caller's memory holds
            new = new.filter(F.when(hyperslab.box(rank, start, count, stride), True).otherwise(outside.cast("boolean")) if all(count) else F.lit(False))
        record = self.catalog.is_record(v)
        beyond = record and start is not None and start[0] >= self.catalog.numrecs  # no variable has a cell there yet
        if record and start is None:
            last = new.agg(F.max("i0")).first()[0]
            self.catalog.numrecs = max(self.catalog.numrecs, 0 if last is None else last + 1)
        elif record and all(count):  # an empty box adds no record
            self.catalog.numrecs = max(self.catalog.numrecs, start[0] + (count[0] - 1) * (stride[0] if stride else 1) + 1)
        if self._log:
            self._log.put(v.name, new, self._bytes(v, count), start=start, count=count, stride=stride)
            return
        self._merge(v.name, new, (start, count, stride) if boxed else None, beyond)

    def _merge(self, name: str, new: DataFrame, box: tuple | None = None, beyond: bool = False) -> None:
        """Cells over those a variable has; and for the file, if it has this layout."""
        old = self.cells[name]
        self.cells[name] = update.append(old, new) if beyond or name in self._unwritten else update.put_box(old, new, *box) if box else update.put(old, new)
        self._on_file.discard(name)
        self._unwritten.discard(name)
        if self._in_place:
            self._patches.append((name, new))

    def _flush_log(self) -> None:
        """Logged writes reach their variables, in rounds."""
        if self._log:
            for part in self._log.rounds():
                for name, cells in part.items():
                    self._merge(name, cells)

    def mput(self, requests: dict) -> None:
        """One box for each of several variables: name to the arguments of ``put``, in order."""
        for name, how in requests.items():
            self.put(name, **how)

    def put_varn(self, var, cells: DataFrame, dtype: str | None = None) -> None:
        """Cells of a batch of boxes (box, start_offset, coordinates, v): where boxes overlap the lower segment start wins."""
        self._checked(var, dtype, True, None, None, None, None)
        self.put(var, update.settle(cells), dtype=dtype)

    def put_vard(self, *_, **__):
        raise ArrayError(Code.NOTSUPPORT)

    get_vard = put_vard

    def fill_var_rec(self, var, record: int) -> None:
        v = self._checked(var, None, True, None, None, None, None)
        if not self.catalog.is_record(v):
            raise ArrayError(Code.NOTRECVAR, v.name)
        if v.no_fill and v.att("_FillValue") is None:
            raise ArrayError(Code.NOTFILL, v.name)
        one = update.fill_record(self.spark, record, self.catalog.shape(v)[1:], v.xtype, self._own_fill(v))
        self.put(var, one)
        self.catalog.numrecs = max(self.catalog.numrecs, record + 1)

    def _own_fill(self, v: Var):
        return None if v.att("_FillValue") is None else self._fill(v)

    def filled(self, var) -> DataFrame:
        """All cells of a variable, the unwritten ones as fill."""
        v = self.catalog.var(var)
        self._flush_log()
        return update.densify(self.cells[v.name], self.catalog.shape(v), v.xtype, self._own_fill(v)) if v.dims else self.cells[v.name]

    def with_nulls(self, var) -> DataFrame:
        v = self.catalog.var(var)
        self._flush_log()
        return cv.with_nulls(self.cells[v.name], "v", v.xtype, self._own_fill(v))

    # deferred requests

    def _post(self, kind: str, call: str, **request) -> int:
        out = self._ids[kind]
        self._ids[kind] += 2  # even: writes; odd: reads
        self._requests[out] = {"call": call, **request}
        return out

    def iget(self, var, **how) -> int:
        return self._post("get", "get", args=[var], how=how)

    def iput(self, var, cells: DataFrame, **how) -> int:
        return self._post("put", "put", args=[var, cells], how=how, bytes=0)

    def bput(self, var, cells: DataFrame, **how) -> int:
        """The cells as they are now: their rows are copied, and count against the attached buffer."""
        copied, n = self._buffered(var, cells)
        return self._post("put", "put", args=[var, copied], how=how, bytes=n)

    def iget_varn(self, var, boxes: list[tuple], **how) -> int:
        return self._post("get", "get_varn", args=[var, boxes], how=how)

    def iput_varn(self, var, cells: DataFrame, **how) -> int:
        return self._post("put", "put_varn", args=[var, cells], how=how, bytes=0)

    def bput_varn(self, var, cells: DataFrame, **how) -> int:
        copied, n = self._buffered(var, cells)
        return self._post("put", "put_varn", args=[var, copied], how=how, bytes=n)

    def _buffered(self, var, cells: DataFrame) -> tuple[DataFrame, int]:
        if self._buffer is None:
            raise ArrayError(Code.NULLABUF)
        n = cells.count() * external(self.catalog.var(var).xtype).size
        if self._used() + n > self._buffer:
            raise ArrayError(Code.INSUFFBUF)
        rows = cells.collect()  # at most as large as the attached buffer
        return self.spark.createDataFrame(rows, cells.schema), n

    def _used(self) -> int:
        return sum(r.get("bytes", 0) for r in self._requests.values())

    def buffer_attach(self, n: int) -> None:
        if n <= 0:
            raise ArrayError(Code.NULLBUF)
        if self._buffer is not None:
            raise ArrayError(Code.PREVATTACHBUF)
        self._buffer = n

    def buffer_detach(self) -> None:
        if self._buffer is None:
            raise ArrayError(Code.NULLABUF)
        if self._used():
            raise ArrayError(Code.PENDINGBPUT)
        self._buffer = None

    def _chosen(self, ids) -> list[int]:
        if ids in (ALL, ALL_GETS, ALL_PUTS):
            return [r for r in sorted(self._requests) if ids == ALL or (r % 2 == 1) == (ids == ALL_GETS)]
        for r in ids:
            if r not in self._requests:
                raise ArrayError(Code.INVAL_REQUEST, str(r))
        return list(ids)

    def wait(self, ids=ALL) -> dict[int, DataFrame]:
        """Commits requests: all writes, in order of their ids, before all reads.  Returns the reads' cells."""
        chosen = self._chosen(ids)
        self._flush_log()
        for r in (r for r in sorted(chosen) if r % 2 == 0):
            self._commit(r)
        return {r: self._commit(r) for r in sorted(chosen) if r % 2 == 1}

    def _commit(self, request: int):
        q = self._requests.pop(request)
        return getattr(self, q["call"])(*q["args"], **q["how"])

    wait_all = wait

    def cancel(self, ids=ALL) -> None:
        for r in self._chosen(ids):
            del self._requests[r]
