"""A dataset in several files: each variable is cut along one dimension, and a stub says what lies where."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import UNLIMITED
from ..operators import hyperslab
from .catalog import Catalog
from .dataset import Dataset

STUB = "stub.nc"
#: Attributes: of a stub's variable how many files it lies in, its dimensions and the one it is cut along; of a file's variable
#: the range that the file has of that dimension.
COUNT, DIMS, CUT, RANGE = "subfiles_count", "subfiles_dims", "subfiles_cut", "subfiles_range"


def cut_dimension(c: Catalog, name: str, wanted: dict[str, str] | None = None) -> int | None:
    """Which of a variable's dimensions is cut: the one that is asked for, else the first that is no record dimension."""
    v = c.var(name)
    for k, d in enumerate(v.dims):
        if c.dims[d].size != UNLIMITED and (wanted or {}).get(name, c.dims[d].name) == c.dims[d].name:
            return k
    return None


def save(d: Dataset, folder: str, n: int, wanted: dict[str, str] | None = None) -> None:
    """Writes ``n`` files and a stub into ``folder``.  File k has the indices from ceil(size / n * k) of the cut dimension.

    A variable without such a dimension, or shorter than ``n`` along it, stays in the stub whole.
    """
    os.makedirs(folder, exist_ok=True)
    c, cuts = d.catalog, {}
    for v in c.vars:
        k = cut_dimension(c, v.name, wanted)
        if k is not None and c.shape(v)[k] >= n:
            cuts[v.name] = k
    stub = Dataset.create(d.spark, f"{folder}/{STUB}", c.version)
    for x in c.dims:
        stub.def_dim(x.name, x.size)
    for a in c.atts:
        stub.put_att(a.name, a.values, None, a.xtype)
    for v in c.vars:
        stub.def_var(v.name, v.xtype, [] if v.name in cuts else list(v.dims))
        for a in v.atts:
            stub.put_att(a.name, a.values, v.name, a.xtype)
        if v.name in cuts:
            stub.put_att(COUNT, [n], v.name, "int")
            stub.put_att(DIMS, " ".join(c.dims[x].name for x in v.dims), v.name)
            stub.put_att(CUT, [cuts[v.name]], v.name, "int")
    stub.enddef()
    for v in c.vars:
        if v.name not in cuts:
            stub.put(v.name, d.get(v.name))
    stub.close()
    for f in range(n):
        part = Dataset.create(d.spark, f"{folder}/{f}.nc", c.version)
        if any(x.size == UNLIMITED for x in c.dims):
            part.def_dim(next(x.name for x in c.dims if x.size == UNLIMITED))
        ranges = {}
        for name, k in cuts.items():
            v, size = c.var(name), c.shape(c.var(name))[k]
            lo, hi = -(-f * size // n), -(-(f + 1) * size // n)
            ranges[name] = lo, hi
            dims = []
            for j, x in enumerate(v.dims):
                here = c.dims[x].name if j != k else f"{c.dims[x].name}.{name}"
                if here not in [y.name for y in part.catalog.dims]:
                    part.def_dim(here, c.dims[x].size if j != k else hi - lo)
                dims.append(here)
            part.def_var(name, v.xtype, dims)
            for a in v.atts:
                if a.name == "_FillValue":
                    part.put_att(a.name, a.values, name, a.xtype)
            part.put_att(RANGE, [lo, hi], name, "int64" if c.version == 5 else "int")
        part.enddef()
        for name, k in cuts.items():
            lo, hi = ranges[name]
            i = F.col(f"i{k}")
            part.put(name, d.get(name).filter((i >= lo) & (i < hi)).withColumn(f"i{k}", i - lo))
        part.close()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All cells of a variable, from the files that have it."""
    stub = Dataset.open(spark, f"{folder}/{STUB}")
    atts = {a.name: a.values for a in stub.catalog.var(name).atts}
    if COUNT not in atts:
        return stub.get(name)
    k, out = atts[CUT][0], None
    for f in range(atts[COUNT][0]):
        part = Dataset.open(spark, f"{folder}/{f}.nc")
        lo = part.get_att(RANGE, name)[0]
        cells = part.get(name).withColumn(f"i{k}", F.col(f"i{k}") + lo)
        out = cells if out is None else out.unionByName(cells)
    return out


def owner(d: Dataset, name: str, n: int, wanted: dict[str, str] | None = None):
    """The file of a cell, as an expression over its coordinates."""
    c = d.catalog
    k = cut_dimension(c, name, wanted)
    return hyperslab.subfile(c.shape(c.var(name)), n, k)
