"""Comparing two datasets: what their headers say, then the cells of the variables that have one shape in both."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import UNLIMITED
from ..operators import compare
from .catalog import Att, Catalog
from .dataset import Dataset


def facts(c: Catalog) -> dict[tuple, object]:
    """A header as named facts, so that two headers are compared as two tables are."""
    out: dict[tuple, object] = {("format",): c.version, ("ndims",): len(c.dims), ("nvars",): len(c.vars), ("natts",): len(c.atts)}

    def held(owner: str, atts: list[Att]) -> None:
        for a in atts:
            # values as text: NaN in an attribute is the same on both sides
            out["attribute", owner, a.name] = (a.xtype, len(a.values), repr(a.values))

    held("", c.atts)
    for k, d in enumerate(c.dims):
        out["dimension", d.name] = (c.numrecs if k in _records(c) else d.size, k in _records(c))
    for v in c.vars:
        out["variable", v.name] = (v.xtype, tuple(c.dims[d].name for d in v.dims), tuple(c.shape(v)))
        held(v.name, v.atts)
    return out


def _records(c: Catalog) -> set[int]:
    return {k for k, d in enumerate(c.dims) if d.size == UNLIMITED}


@dataclass
class Report:
    """``header``: facts that differ, as (fact, first, second), None where one lacks it.  ``skipped``: variables not compared, and
    why.  ``cells``: for each compared variable its differing cells.  ``lacking``: variables only one dataset has."""

    header: list[tuple] = field(default_factory=list)
    skipped: dict[str, str] = field(default_factory=dict)
    cells: dict[str, DataFrame] = field(default_factory=dict)
    lacking: list[str] = field(default_factory=list)

    def counts(self, spark) -> DataFrame:
        """Differing cells of each compared variable, as one query over all of them."""
        out = spark.createDataFrame([], "name string, n_differ long")
        for name, df in self.cells.items():
            out = out.unionByName(df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_differ")).select("name", "n_differ"))
        return out

    def same(self, spark) -> bool:
        return not (self.header or self.lacking or self.skipped) and self.counts(spark).filter("n_differ > 0").isEmpty()


def diff(a: Dataset, b: Dataset, variables: list[str] | None = None, header: bool = True, absolute: float | None = None, ratio: float | None = None) -> Report:
    """Headers and variables of two datasets.

    ``variables``: only these are compared.  A variable with another type or shape in the other dataset is skipped; so is,
    silently, a record variable without records.  Tolerances as in ``compare.differs``.
    """
    out = Report()
    if header:
        x, y = facts(a.catalog), facts(b.catalog)
        out.header = [(k, x.get(k), y.get(k)) for k in [*x, *(k for k in y if k not in x)] if x.get(k) != y.get(k)]
    ours, theirs = ({v.name: v for v in d.catalog.vars} for d in (a, b))
    for name in variables if variables is not None else dict.fromkeys([*ours, *theirs]):
        if name not in ours or name not in theirs:
            out.lacking.append(name)
            continue
        v, w = ours[name], theirs[name]
        if v.xtype != w.xtype:
            out.skipped[name] = "type"
        elif a.catalog.shape(v) != b.catalog.shape(w):
            out.skipped[name] = "shape"
        elif not a.catalog.is_record(v) or a.catalog.numrecs:
            one, other = _dense(a, name), _dense(b, name)
            out.cells[name] = compare.diff(one, other, absolute, ratio) if v.dims else compare.diff(_scalar(one), _scalar(other), absolute, ratio).drop("i0")
    return out


def _dense(d: Dataset, name: str) -> DataFrame:
    """All cells; a file has them all, a table may lack those never written, which read as fill."""
    return d.get(name) if name in d._on_file else d.filled(name)


def _scalar(df: DataFrame) -> DataFrame:
    return df.select(F.lit(0).cast("long").alias("i0"), "v")


def status(spark, report: Report, quiet: bool = False) -> tuple[int, list[str]]:
    """The exit status of a comparison, 1 if anything differs, and what to print; nothing if ``quiet``."""
    lines = [f"DIFFER: {' '.join(k)}: {x} <> {y}" for k, x, y in report.header]
    lines += [f"LACKING: {name}" for name in report.lacking] + [f"SKIPPED: {name}: {why}" for name, why in report.skipped.items()]
    if report.cells:
        lines += [f"DIFFER: variable {r.name}: {r.n_differ} cells" for r in report.counts(spark).filter("n_differ > 0").orderBy("name").collect()]
    return int(bool(lines)), [] if quiet else lines
