"""Queries through ``Dataset``: the driver's tables put into datasets and files, and read back, with the SQL that says the same.

A dataset here has QTY int (supp, line) and EVT double (time), a record variable; see ``catalogue``.
"""

from __future__ import annotations

import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import convert as cv
from ..functions.types import TYPES, ArrayError, Code, external
from ..operators import hyperslab, requests, update
from ..sources import cdf, cdl
from . import dataset as ds
from .catalog import Catalog
from .catalogue import _QTY, _PUT, _folder, _new_box, _new_sql, _query, _read, acct, evt, qty
from .dataset import Dataset

_N = "(select max(s_suppkey) + 1 from supplier)"


def _n_supp(spark, d) -> int:
    return int(_read(spark, d, "supplier").agg(F.max("s_suppkey") + 1).first()[0])


def _defined(spark, d, path=None, version=5, fill=False, hints=None) -> Dataset:
    x = Dataset.create(spark, path, version, hints=hints)
    x.def_dim("time")
    x.def_dim("supp", _n_supp(spark, d))
    x.def_dim("line", 8)
    x.set_fill(fill)
    x.def_var("QTY", "int", ["supp", "line"])
    x.def_var("EVT", "double", ["time"])
    return x


def _filled(spark, d, path=None, version=5, hints=None, put=True) -> Dataset:
    x = _defined(spark, d, path, version, hints=hints)
    x.enddef()
    x.put("QTY", qty(spark, d))
    if put:
        x.put("EVT", evt(spark, d))
    return x


def _file(spark, d, version=5) -> str:
    path = f"{_folder(spark)}/tables.nc"
    _filled(spark, d, path, version).close()
    return path


def _written(df: DataFrame) -> DataFrame:
    """Cells that were put; a file has all others as fill."""
    return df.filter(~cv.is_fill(F.col("v"), "int"))


def _status(f, *args, **how) -> int:
    try:
        f(*args, **how)
        return 0
    except ArrayError as e:
        return int(e.code)


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- blocking writes


@_query("put_var1_point", _PUT.format(old=_QTY, new="(select 3::bigint as i0, 2::bigint as i1, 999 as v)"))
def put_var1_point(spark, d):
    x = _filled(spark, d, put=False)
    x.put("QTY", _rows(spark, [(3, 2, 999)], "i0 long, i1 long, v int"), [3, 2])
    return x.get("QTY")


@_query("put_var_whole", f"select i0, i1, v + 1 as v from {_QTY}")
def put_var_whole(spark, d):
    x = _filled(spark, d, put=False)
    x.put("QTY", qty(spark, d).withColumn("v", F.col("v") + 1))
    return x.get("QTY")


@_query("put_vars_dataset", _PUT.format(old=_QTY, new=_new_sql(4, 3, 1, 0, 2, 2)))
def put_vars_dataset(spark, d):
    x = _filled(spark, d, put=False)
    x.put("QTY", _new_box(spark, 4, 3, 1, 0, 2, 2), [1, 0], [4, 3], [2, 2])
    return x.get("QTY")


@_query("put_varm_memory", _PUT.format(old=_QTY, new="(select 1 + event_id % 3 as i0, 1 + event_id // 3 as i1, (event_id * 10 + user_id % 10)::integer as v from events where event_id < 15)"))
def put_varm_memory(spark, d):
    """Memory (the first 15 events) written column by column through a map."""
    memory = _read(spark, d, "events").filter("event_id < 15").select(F.col("event_id").alias("address"), (F.col("event_id") * 10 + F.col("user_id") % 10).cast("int").alias("v"))
    x = _filled(spark, d, put=False)
    x.put("QTY", memory, [1, 1], [3, 5], imap=[1, 3])
    return x.get("QTY")


@_query("mput_two", f"select 'QTY' as var, i0, i1, v::double as v from ({_PUT.format(old=_QTY, new=_new_sql(3, 2, 0, 0))}) union all select 'EVT', event_id, -1, case when event_id between 5 and 9 then event_id * 0.5::double else value end from events")
def mput_two(spark, d):
    x = _filled(spark, d)
    some = spark.range(5, 10).select(F.col("id").alias("i0"), (F.col("id") * 0.5).alias("v"))
    x.mput({"QTY": {"cells": _new_box(spark, 3, 2, 0, 0), "start": [0, 0], "count": [3, 2]}, "EVT": {"cells": some, "start": [5], "count": [5]}})
    return hyperslab.mget({"QTY": x.get("QTY"), "EVT": x.get("EVT")}).withColumn("i1", F.coalesce("i1", F.lit(-1)))


@_query("vard_refused", f"select 'get_vard' as call, {int(Code.NOTSUPPORT)} as status union all select 'put_vard', {int(Code.NOTSUPPORT)}")
def vard_refused(spark, d):
    x = _filled(spark, d, put=False)
    return _rows(spark, [("get_vard", _status(x.get_vard, "QTY")), ("put_vard", _status(x.put_vard, "QTY"))], "call string, status int")


@_query("mode_errors", " union all ".join(f"select '{a}' as call, {int(b)} as status" for a, b in (("get in define mode", Code.INDEFINE), ("independent call", Code.NOTINDEP), ("collective call", Code.INDEP), ("end without begin", Code.NOTINDEP), ("define in data mode", Code.NOTINDEFINE), ("char for numbers", Code.CHAR))))
def mode_errors(spark, d):
    x = _defined(spark, d)
    out = [("get in define mode", _status(x.get, "QTY"))]
    x.enddef()
    out.append(("independent call", _status(x.get, "QTY", collective=False)))
    x.begin_indep_data()
    out.append(("collective call", _status(x.get, "QTY", collective=True)))
    x.end_indep_data()
    out += [("end without begin", _status(x.end_indep_data)), ("define in data mode", _status(x.def_dim, "more", 3)), ("char for numbers", _status(x.get, "QTY", dtype="char"))]
    return _rows(spark, out, "call string, status int")


# --- deferred requests


@_query("nb_wait_all", f"select i0, i1, v from ({_PUT.format(old=f'({_PUT.format(old=_QTY, new=_new_sql(5, 4, 2, 1))})', new=_new_sql(3, 3, 4, 2))}) where i0 < 9")
def nb_wait_all(spark, d):
    """The read was posted before the second write and sees both: writes are committed first, in order."""
    x = _filled(spark, d, put=False)
    x.iput("QTY", _new_box(spark, 5, 4, 2, 1), start=[2, 1], count=[5, 4])
    get = x.iget("QTY", start=[0, 0], count=[9, 8])
    x.iput("QTY", _new_box(spark, 3, 3, 4, 2), start=[4, 2], count=[3, 3])
    return x.wait()[get]


@_query("wait_all_numrecs", "select greatest(max(event_id) + 1, max(case when user_id % 4 > 0 then event_id + (user_id % 4 - 1) * 50 + 1 else 0 end))::bigint as numrecs from events where event_id < 9 or event_id = (select max(event_id) from events)")
def wait_all_numrecs(spark, d):
    """Record writes of ten events' starts and counts, deferred; the record count after wait."""
    x = _filled(spark, d)
    asked = _read(spark, d, "events").select("event_id", "user_id")
    last = asked.agg(F.max("event_id")).first()[0]
    for e, u in asked.filter((F.col("event_id") < 9) | (F.col("event_id") == last)).collect():
        n = u % 4
        x.iput("EVT", spark.range(n).select((F.lit(e) + F.col("id") * 50).alias("i0"), F.lit(1.0).alias("v")), start=[e], count=[n], stride=[50])
    x.wait()
    return _rows(spark, [(x.catalog.numrecs,)], "numrecs long")


@_query("nb_varn", f"select box::bigint as box, i0, i1, v from ({_PUT.format(old=_QTY, new=_new_sql(2, 3, 1, 1))}) q join (values (0, 0, 0, 3, 8), (1, 1, 1, 4, 2)) b(box, s0, s1, c0, c1) on i0 >= s0 and i0 < s0 + c0 and i1 >= s1 and i1 < s1 + c1")
def nb_varn(spark, d):
    x = _filled(spark, d, put=False)
    cells = _new_box(spark, 2, 3, 1, 1).select(F.lit(0).alias("box"), (F.col("i0") * 8 + 1).alias("start_offset"), "i0", "i1", "v")
    get = x.iget_varn("QTY", [([0, 0], [3, 8]), ([1, 1], [4, 2])])
    x.iput_varn("QTY", cells)
    return x.wait()[get]


@_query("nb_bput", f"select i0, i1, v from ({_PUT.format(old=_QTY, new=_new_sql(2, 2, 0, 0))}) where i0 < 4")
def nb_bput(spark, d):
    x = _filled(spark, d, put=False)
    x.buffer_attach(64)
    x.bput("QTY", _new_box(spark, 2, 2, 0, 0), start=[0, 0], count=[2, 2])
    used = x.inq()["buffer_usage"]
    assert used == 16 and _status(x.buffer_detach) == Code.PENDINGBPUT
    x.wait()
    x.buffer_detach()
    return x.get("QTY", [0, 0], [4, 8])


@_query("nb_cancel", f"select i0, i1, v, 0 as pending from {_QTY}")
def nb_cancel(spark, d):
    x = _filled(spark, d, put=False)
    x.iput("QTY", _new_box(spark, 5, 4, 2, 1), start=[2, 1], count=[5, 4])
    x.cancel()
    x.wait()
    return x.get("QTY").withColumn("pending", F.lit(x.inq()["nreqs"]))


@_query("split_record_requests", "select event_id as req, unnest(range(event_id, event_id + (user_id % 5) * (1 + user_id % 7), 1 + user_id % 7))::bigint as record from events where user_id % 5 > 0")
def split_record_requests(spark, d):
    """A request of each event: its records, one sub-request each."""
    asked = _read(spark, d, "events").select(F.col("event_id").alias("req"), F.col("event_id").alias("start"), (F.col("user_id") % 5).alias("count"), (1 + F.col("user_id") % 7).alias("stride"))
    return update.split_records(asked)


# --- definition and attributes


@_query("attributes", "select -1 as varid, 0 as attnum, 'title' as name, 'char' as xtype, 5 as n, 'parts' as value union all select 0, 0, 'valid_range', 'int', 2, min(v)::varchar || ' ' || max(v)::varchar from " + _QTY + " union all select 0, 1, 'units', 'char', 2, 'kg' union all select 1, 0, 'count', 'int64', 1, count(*)::varchar from events")
def attributes(spark, d):
    x = _defined(spark, d)
    low, high = qty(spark, d).agg(F.min("v"), F.max("v")).first()
    x.put_att("title", "parts")
    x.put_att("valid_range", [low, high], "QTY")
    x.put_att("note", "gone", "QTY")
    x.put_att("unit", "kg", "QTY")
    x.put_att("count", [_read(spark, d, "events").count()], "EVT", "int64")
    x.rename_att("unit", "units", "QTY")
    x.del_att("note", "QTY")
    return x.atts()


@_query("att_convert", "select 'byte' as xtype, (case when max(c_custkey) <= 127 then max(c_custkey) else -127 end)::double as v from customer union all select 'short', (case when max(c_custkey) <= 32767 then max(c_custkey) else -32767 end)::double from customer union all select 'double', max(c_custkey)::double from customer union all select 'copied', max(c_custkey)::double from customer")
def att_convert(spark, d):
    x, y = _defined(spark, d), _defined(spark, d)
    x.put_att("last", [acct(spark, d).agg(F.max("i0")).first()[0]], "QTY", "int")
    x.copy_att("last", "QTY", y, "EVT")
    return _rows(spark, [*[(t, float(x.get_att("last", "QTY", t)[0])) for t in ("byte", "short", "double")], ("copied", float(y.get_att("last", "EVT")[0]))], "xtype string, v double")


@_query("inq_one_by_one", f"select 'dim supp' as item, {_N}::bigint as n union all select 'dim time', count(*) from events union all select 'var QTY rank', 2 union all select 'att of QTY', 3 union all select 'unlimited', 0 union all select 'version', 5 union all select 'put bytes', {_N} * 8 * 4 + (select count(*) * 8 from events) union all select 'get bytes', 3 * 8 * 4")
def inq_one_by_one(spark, d):
    x = _defined(spark, d)
    x.put_att("unit", "kg", "QTY")
    x.put_att("unit", "kgs", "QTY")
    x.enddef()
    x.catalog.numrecs = _read(spark, d, "events").count()
    x.put("QTY", qty(spark, d))
    x.put("EVT", evt(spark, d))
    x.get("QTY", [0, 0], [3, 8])
    q = x.inq()
    rows = [("dim supp", x.inq_dim("supp")[1]), ("dim time", x.inq_dim(0)[1]), ("var QTY rank", x.inq_var("QTY")["ndims"]), ("att of QTY", x.inq_att("unit", "QTY")["len"]), ("unlimited", q["unlimdim"]), ("version", q["version"]), ("put bytes", q["put_size"]), ("get bytes", q["get_size"])]
    return _rows(spark, rows, "item string, n long")


@_query("rename_items", "select 'dim' as kind, unnest(['time', 's', 'line']) as name union all select 'var', unnest(['Q', 'EVT'])")
def rename_items(spark, d):
    x = _defined(spark, d)
    x.rename_dim("supp", "s")
    x.rename_var("QTY", "Q")
    return x.dims().select(F.lit("dim").alias("kind"), "name").unionByName(x.vars().select(F.lit("var").alias("kind"), "name"))


@_query("name_lookup", "select s_name as name, (row_number() over (order by s_suppkey) - 1)::integer as varid, (512 + (row_number() over (order by s_suppkey) - 1) * 4)::bigint - 512 as at from supplier")
def name_lookup(spark, d):
    """A scalar variable for each supplier, found again by its name."""
    names = [r[0] for r in _read(spark, d, "supplier").orderBy("s_suppkey").select("s_name").collect()]  # a catalogue
    c = Catalog(5)
    for name in names:
        c.def_var(name, "int", [])
    c.lay_out()
    found = {v.name: (k, v.begin) for k, v in enumerate(c.vars)}
    return _rows(spark, [(n, found[c.var(n).name][0], found[n][1] - c.vars[0].begin) for n in names], "name string, varid int, at long")


@_query("size_limits", " union all ".join(f"select {v} as version, {n}::bigint as elements, {s} as status" for v, n, s in ((1, 2**29 - 1, 0), (1, 2**30, -62), (2, 2**30 - 1, 0), (2, 2**31 - 1, -62), (5, 2**31, 0))))
def size_limits(spark, d):
    """A variable of so many ints before another one: the limits of the formats."""

    def status(version: int, n: int) -> int:
        c = Catalog(version)
        c.def_dim("n", n)
        c.def_var("a", "int", ["n"])
        c.def_var("b", "int", ["n"])
        return _status(c.check_sizes)

    cases = ((1, 2**29 - 1), (1, 2**30), (2, 2**30 - 1), (2, 2**31 - 1), (5, 2**31))
    return _rows(spark, [(v, n, status(v, n)) for v, n in cases], "version int, elements long, status int")


@_query("hint_precedence", "select 'default' as told, 512::bigint as begin union all select 'argument', 1024 union all select 'hint', 2048 union all select 'environment', 4096")
def hint_precedence(spark, d):
    def begin(hints=None, **align) -> int:
        x = _defined(spark, d, hints=hints)
        x.enddef(**align)
        return x.inq_var("QTY")["offset"]

    hint, rows = {"nc_var_align_size": "2048"}, []
    rows += [("default", begin()), ("argument", begin(v_align=1024)), ("hint", begin(hint, v_align=1024))]
    before = os.environ.get(ds.HINTS_VARIABLE)
    os.environ[ds.HINTS_VARIABLE] = "nc_var_align_size=4096"
    try:
        rows.append(("environment", begin(hint, v_align=1024)))
    finally:
        os.environ.pop(ds.HINTS_VARIABLE)
        if before is not None:
            os.environ[ds.HINTS_VARIABLE] = before
    return _rows(spark, rows, "told string, begin long")


@_query("default_format", "select 1 as before, 5 as new, 1 as after")
def default_format(spark, d):
    before = ds.set_default_format(5)
    new = _n_version(spark)
    ds.set_default_format(before)
    return _rows(spark, [(before, new, _n_version(spark))], "before int, new int, after int")


def _n_version(spark) -> int:
    return Dataset.create(spark).catalog.version


# --- filling


@_query("fill_mode", f"select count(*)::bigint as cells, (count(*) - (select count(*) from {_QTY}))::bigint as fills from (select unnest(range({_N})) as i0), (select unnest(range(8)) as i1)")
def fill_mode(spark, d):
    x = _defined(spark, d, fill=True)
    x.enddef()
    x.put("QTY", qty(spark, d))
    return x.get("QTY").agg(F.count(F.lit(1)).alias("cells"), F.sum(cv.is_fill(F.col("v"), "int").cast("long")).alias("fills"))


@_query("fill_own_value", f"select g.i0, g.i1, coalesce(q.v, -9) as v from (select i0, i1 from (select unnest(range({_N})) as i0), (select unnest(range(8)) as i1)) g left join {_QTY} q on q.i0 = g.i0 and q.i1 = g.i1")
def fill_own_value(spark, d):
    path = f"{_folder(spark)}/fill.nc"
    x = _defined(spark, d, path)
    x.def_var_fill("QTY", False, -9)
    x.enddef()
    x.put("QTY", qty(spark, d))
    x.close()
    return Dataset.open(spark, path).get("QTY")


@_query("fill_var_rec", "select max(event_id) + 4 as numrecs, 9.969209968386869e36::double as v from events")
def fill_var_rec(spark, d):
    x = _defined(spark, d)
    x.def_var_fill("EVT", False)
    x.enddef()
    x.put("EVT", evt(spark, d))
    last = x.catalog.numrecs + 2
    x.fill_var_rec("EVT", last)
    return x.get("EVT", [last], [1]).select(F.lit(x.catalog.numrecs).cast("long").alias("numrecs"), "v")


# --- files


def _kind_sql(t: str) -> str:
    if t in ("float", "double"):
        return "(v / 4)::double"
    return "v::double"


for _t in ("byte", "short", "int", "float", "double", "ubyte", "ushort", "uint", "int64", "uint64"):

    def _typed(spark, d, t=_t):
        path = f"{_folder(spark)}/typed.nc"
        x = Dataset.create(spark, path, 5)
        x.def_dim("supp", _n_supp(spark, d))
        x.def_dim("line", 8)
        x.def_var("V", t, ["supp", "line"])
        x.enddef()
        v = F.col("v") / 4 if t in ("float", "double") else F.col("v") % 100 if external(t).size == 1 else F.col("v")
        x.put("V", qty(spark, d).withColumn("v", v.cast(external(t).spark)))
        x.close()
        cells = Dataset.open(spark, path).get("V")
        return cells.filter(~cv.is_fill(F.col("v"), t, cv.fill_literal(TYPES[t]))).withColumn("v", F.col("v").cast("double"))

    _value = "(v % 100)::double" if external(_t).size == 1 else _kind_sql(_t)
    _query(f"file_{_t}", f"select i0, i1, {_value} as v from {_QTY}")(_typed)


@_query("file_char", "select s_suppkey as i0, s_name as line from supplier")
def file_char(spark, d):
    """Names as rows of characters, through a file."""
    path = f"{_folder(spark)}/names.nc"
    names = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("i0"), "s_name")
    n, wide = names.agg(F.max("i0") + 1, F.max(F.length("s_name"))).first()
    x = Dataset.create(spark, path, 1)
    x.def_dim("supp", int(n))
    x.def_dim("ch", int(wide))
    x.def_var("NAME", "char", ["supp", "ch"])
    x.enddef()
    x.put("NAME", names.select("i0", F.posexplode(F.split("s_name", "")).alias("i1", "c")).select("i0", F.col("i1").cast("long").alias("i1"), F.encode("c", "UTF-8").alias("v")))
    x.close()
    cells = Dataset.open(spark, path).get("NAME").filter(F.hex("v") != "00")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i1", "v"))), lambda c: F.decode(c["v"], "UTF-8")), "")
    return cells.groupBy("i0").agg(text.alias("line"))


@_query("file_in_place", f"select i0, i1, v from ({_PUT.format(old=_QTY, new=_new_sql(5, 4, 2, 1))})")
def file_in_place(spark, d):
    """One box written into an existing file; nothing else of it is touched."""
    path = _file(spark, d)
    node, size = os.stat(path).st_ino, os.path.getsize(path)
    x = Dataset.open(spark, path, write=True)
    x.put("QTY", _new_box(spark, 5, 4, 2, 1), [2, 1], [5, 4])
    x.close()
    assert (os.stat(path).st_ino, os.path.getsize(path)) == (node, size)
    return _written(Dataset.open(spark, path).get("QTY"))


@_query("file_redefined", f"select 'QTY' as var, i0, i1, v::double as v from {_QTY} union all select 'EVT', event_id, -1, value from events union all select 'NEW', s_suppkey, -1, s_suppkey * 2 from supplier")
def file_redefined(spark, d):
    """A file reopened for definition: the old variables move and keep their cells."""
    path = _file(spark, d, 2)
    x = Dataset.open(spark, path, write=True)
    x.redef()
    x.put_att("history", "redefined " * 200)
    x.def_var("NEW", "double", ["supp"])
    x.enddef()
    x.put("NEW", _read(spark, d, "supplier").select(F.col("s_suppkey").alias("i0"), (F.col("s_suppkey") * 2.0).alias("v")))
    x.close()
    y = Dataset.open(spark, path)
    new = y.get("NEW").filter(~cv.is_fill(F.col("v"), "double"))
    return hyperslab.mget({"QTY": _written(y.get("QTY")), "EVT": y.get("EVT"), "NEW": new}).withColumn("i1", F.coalesce("i1", F.lit(-1)))


@_query("file_sync_numrecs", "select max(event_id) + 1 as synced, max(event_id) + 4 as closed from events")
def file_sync_numrecs(spark, d):
    path = f"{_folder(spark)}/sync.nc"
    x = _filled(spark, d, path)
    x.sync()
    synced = cdf.read_header(path).numrecs
    x.put("EVT", _rows(spark, [(synced + 2, 1.5)], "i0 long, v double"), [synced + 2], [1])
    x.close()
    return _rows(spark, [(synced, cdf.read_header(path).numrecs)], "synced long, closed long")


@_query("file_kinds", "select * from (values ('cdf1', 'CDF-1', 0), ('cdf2', 'CDF-2', 0), ('cdf5', 'CDF-5', 0), ('hdf5', 'HDF5', -214), ('bp', 'BP', -214), ('text', 'unknown', -51), ('none', 'none', -220)) t(file, kind, status)")
def file_kinds(spark, d):
    folder = _folder(spark)
    for version in (1, 2, 5):
        cdf.create(f"{folder}/cdf{version}", _filled(spark, d, None, version, put=False).catalog)
    for name, data in (("hdf5", b"\0" * 512 + b"\x89HDF\r\n\x1a\n" + b"\0" * 64), ("bp", b"x" * 100 + struct.pack("<QQQI", 10, 30, 60, 3)), ("text", b"plain text")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    names = ("cdf1", "cdf2", "cdf5", "hdf5", "bp", "text", "none")
    kind = lambda n: cdf.sniff_path(f"{folder}/{n}") if n != "none" else "none"
    return _rows(spark, [(n, kind(n), _status(Dataset.open, spark, f"{folder}/{n}")) for n in names], "file string, kind string, status int")


@_query("file_delete_abort", "select 0 as deleted, -220 as again, 0 as aborted, -220 as left_behind, -35 as kept")
def file_delete_abort(spark, d):
    path = _file(spark, d)
    kept = _status(Dataset.create, spark, path, clobber=False)
    deleted, again = _status(ds.delete, path), _status(ds.delete, path)
    x = _filled(spark, d, path, put=False)
    aborted = _status(x.abort)
    return _rows(spark, [(deleted, again, aborted, _status(Dataset.open, spark, path), kept)], "deleted int, again int, aborted int, left_behind int, kept int")


_BROKEN = ("begin", "type", "rank", "dimension", "attributes")


def broken(path: str, version: int, what: str) -> int:
    """The status of reading a sound file with one field of its first variable broken."""
    head = bytearray(open(path, "rb").read(1 << 14))
    wide = 8 if version == 5 else 4
    at = head.index(b"QTY\0") + 4  # the rank; then the dimensions, the attributes' tag and count, the type, the size, the begin
    number = lambda k, n, x: head.__setitem__(slice(k, k + n), x.to_bytes(n, "big"))
    atts = at + 3 * wide
    kind = atts + 4 + wide
    if what == "rank":
        number(at, wide, 200)
    elif what == "dimension":
        number(at + wide, wide, 77)
    elif what == "attributes":
        number(atts, 4, 9)
    elif what == "type":
        number(kind, 4, 99)
    else:
        number(kind + 4 + wide, 4 if version == 1 else 8, 4)
    return _status(cdf.decode_header, bytes(head))


@_query("validate_broken", " union all ".join(f"select {v} as version, '{w}' as broken, true as refused" for v in (1, 2, 5) for w in _BROKEN) + " union all select v, 'nothing', false from (values (1), (2), (5)) t(v)")
def validate_broken(spark, d):
    """Files of the tables in each version: sound, and with each of five fields of the header broken."""
    out = []
    for version in (1, 2, 5):
        path = f"{_folder(spark)}/sound.nc"
        cdf.create(path, _filled(spark, d, None, version, put=False).catalog)
        out.append((version, "nothing", bool(cdf.validate(path))))
        out += [(version, what, broken(path, version, what) != 0) for what in _BROKEN]
    return _rows(spark, out, "version int, broken string, refused boolean")


@_query("validate_repair", "select 1 as found, 0 as after, count(*)::bigint as cells from " + _QTY)
def validate_repair(spark, d):
    """Padding that is not null is found and zeroed; the cells stay."""
    path = _file(spark, d)
    with open(path, "r+b") as f:
        at = f.read(1 << 14).index(b"QTY\0") + 3
        f.seek(at)
        f.write(b"\1")
    found = len(cdf.validate(path, repair=True))
    return _written(Dataset.open(spark, path).get("QTY")).agg(F.lit(found).alias("found"), F.lit(len(cdf.validate(path))).alias("after"), F.count(F.lit(1)).alias("cells"))


@_query("file_aggregated", f"select i0, i1, v from {_QTY}")
def file_aggregated(spark, d):
    """Cells in any order gathered to three aggregators by offset, which write a stretch of the file each."""
    path = f"{_folder(spark)}/gathered.nc"
    x = _defined(spark, d, path)
    x.enddef()
    v = x.catalog.var("QTY")
    mixed = qty(spark, d).repartition(5, F.xxhash64("i0", "i1"))
    x.put("QTY", requests.gather(mixed, requests.element_offset(v.begin, x.catalog.shape(v), 4), 3))
    x.close()
    return _written(Dataset.open(spark, path).get("QTY"))


_PADDED = "(length(n) + 3) // 4 * 4"


@_query("inq_header", f"select (4 + 8 + 12 + (select sum(8 + {_PADDED} + 8) from (values ('time'), ('supp'), ('line')) t(n)) + 12 + 12 + (select sum(8 + {_PADDED} + 8 + 8 * r + 12 + 4 + 8 + 8) from (values ('QTY', 2), ('EVT', 1)) t(n, r)))::bigint as header_size, 512::bigint as header_extent, 8::bigint as recsize, count(*)::bigint as numrecs, (512 + {_N} * 32 + count(*) * 8)::bigint as file_size from events")
def inq_header(spark, d):
    path = _file(spark, d)
    q = Dataset.open(spark, path).inq()
    return _rows(spark, [(q["header_size"], q["header_extent"], q["recsize"], q["numrecs"], os.path.getsize(path))], "header_size long, header_extent long, recsize long, numrecs long, file_size long")


# --- planning


@_query("request_bounds", f"select i0 as req, min(512 + (i0 * 8 + i1) * 4)::bigint as first, (max(512 + (i0 * 8 + i1) * 4) + 4)::bigint as past from {_QTY} group by i0")
def request_bounds(spark, d):
    """The byte range that each row of cells spans."""
    off = requests.element_offset(512, [_n_supp(spark, d), 8], 4)
    return requests.bounds(qty(spark, d).select(F.col("i0").alias("req"), "i0", "i1"), off, 4)


_LISTED = f"(select 'QTY' as name, 512::bigint as begin, ({_N} * 32)::bigint as len union all select 'NAMES', 512 + {_N} * 32, 25 * (select count(*) from nation) union all select 'W', 1024 * ((512 + {_N} * 32 + 28 * (select count(*) from nation)) // 1024 + 2), 8)"


def _listed(spark, d) -> DataFrame:
    n, m = _n_supp(spark, d), _read(spark, d, "nation").count()
    at = 1024 * ((512 + n * 32 + 28 * m) // 1024 + 2)
    return _rows(spark, [("QTY", 512, n * 32), ("NAMES", 512 + n * 32, 25 * m), ("W", at, 8)], "name string, begin long, len long")


@_query("offsets_with_gaps", f'select name, begin, begin + len as "end", coalesce(begin - lag(begin + len) over (order by begin), 0)::bigint as gap from {_LISTED}')
def offsets_with_gaps(spark, d):
    return requests.gaps(_listed(spark, d))


@_query("gap_verdict", "select 1 as first, 0 as second")
def gap_verdict(spark, d):
    """Whether fixed variables leave a gap: a listing with one, and the layout of the tables' dataset, which has none."""
    x = _defined(spark, d)
    x.enddef()
    tight = x.vars().filter("not is_rec").select("name", "begin", "len")
    return _rows(spark, [(requests.has_gap(_listed(spark, d)), requests.has_gap(tight))], "first int, second int")


# --- the log, dumps and comparison


@_query("burst_rounds", f"select i0, i1, v from ({_PUT.format(old=f'({_PUT.format(old=_QTY, new=_new_sql(5, 4, 2, 1))})', new=_new_sql(3, 3, 4, 2))})")
def burst_rounds(spark, d):
    """Writes held in a log and applied in rounds of at most 100 bytes when the file is closed; the last one wins."""
    folder = _folder(spark)
    path = f"{folder}/burst.nc"
    x = _filled(spark, d, path, hints={"nc_burst_buf": "enable", "nc_burst_buf_dirname": folder, "nc_burst_buf_flush_buffer_size": "100"}, put=False)
    x.put("QTY", _new_box(spark, 5, 4, 2, 1), [2, 1], [5, 4])
    x.put("QTY", _new_box(spark, 3, 3, 4, 2), [4, 2], [3, 3])
    x.close()
    return _written(Dataset.open(spark, path).get("QTY"))


@_query("log_calls", f"select 0::bigint as seq, 'put_var(QTY, start -, count -, stride -): ' || count(*) || ' cells' as call from {_QTY} union all select 1, 'put_vara(QTY, start [2, 1], count [5, 4], stride -): 20 cells' union all select 2, 'put_vars(EVT, start [0], count [3], stride [2]): 3 cells'")
def log_calls(spark, d):
    folder = _folder(spark)
    x = _filled(spark, d, f"{folder}/log.nc", hints={"nc_burst_buf": "enable", "nc_burst_buf_dirname": folder}, put=False)
    x.put("QTY", _new_box(spark, 5, 4, 2, 1), [2, 1], [5, 4])
    x.put("EVT", spark.range(3).select((F.col("id") * 2).alias("i0"), F.lit(1.5).alias("v")), [0], [3], [2])
    return x._log.calls().select("seq", "call")


@_query("log_cancel_flushed", "select -214 as before, -239 as after")
def log_cancel_flushed(spark, d):
    folder = _folder(spark)
    x = _filled(spark, d, f"{folder}/log.nc", hints={"nc_burst_buf": "enable", "nc_burst_buf_dirname": folder}, put=False)
    before = _status(x._log.cancel, 0)
    x.get("QTY")
    return _rows(spark, [(before, _status(x._log.cancel, 0))], "before int, after int")


@_query("cdl_roundtrip", f"select i0, i1, v from {_QTY}")
def cdl_roundtrip(spark, d):
    """The dataset as text, parsed again."""
    x = _filled(spark, d, put=False)
    text = cdl.dump(x.catalog, {"QTY": x.filled("QTY"), "EVT": x.get("EVT")}, "tables")
    c, data = cdl.parse(text, 5)
    return _written(cdl.frames(spark, c, data)["QTY"])


@_query("cdl_header", f"select * from (values (0, 'netcdf tables {{'), (1, '// file format: CDF-5 (64-bit data)'), (2, 'dimensions:'), (5, chr(9) || 'line = 8 ;'), (6, 'variables:'), (7, chr(9) || 'int QTY(supp, line) ;'), (8, chr(9) || chr(9) || 'QTY:unit = \"kg\" ;'), (9, chr(9) || 'double EVT(time) ;')) t(k, line) union all select 3, chr(9) || 'time = UNLIMITED ; // (' || count(*) || ' currently)' from events union all select 4, chr(9) || 'supp = ' || {_N} || ' ;'")
def cdl_header(spark, d):
    x = _defined(spark, d)
    x.put_att("unit", "kg", "QTY")
    x.enddef()
    x.put("EVT", evt(spark, d))
    return _rows(spark, list(enumerate(cdl.dump_header(x.catalog, "tables").rstrip("\n").split("\n"))), "k int, line string")


@_query("dump_reals", "select c_custkey as i0, printf('%.15g', c_acctbal) as shown from customer")
def dump_reals(spark, d):
    return acct(spark, d).select("i0", cdl.shown(acct(spark, d), "double").alias("shown"))


@_query("dump_precision", "select c_custkey as i0, printf('%.4g', c_acctbal) as shown from customer")
def dump_precision(spark, d):
    return acct(spark, d).select("i0", cdl.shown(acct(spark, d), "double", "%.4g").alias("shown"))


@_query("dump_annotations", f"select i0, i1, '[' || i0 || ',' || i1 || ']' as c_index, '(' || (i1 + 1) || ',' || (i0 + 1) || ')' as fortran_index from {_QTY}")
def dump_annotations(spark, d):
    both = cdl.annotated(cdl.annotated(qty(spark, d)).withColumnRenamed("index", "c_index"), "fortran")
    return both.select("i0", "i1", "c_index", F.col("index").alias("fortran_index"))


@_query("dump_coordinates", "select count(*)::bigint as numbers from supplier")
def dump_coordinates(spark, d):
    """Of a dataset with a coordinate variable, only that one's data are dumped."""
    x = Dataset.create(spark, None, 5)
    n = _n_supp(spark, d)
    x.def_dim("supp", n)
    x.def_var("supp", "int", ["supp"])
    x.def_var("BAL", "double", ["supp"])
    x.enddef()
    keys = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("i0"), F.col("s_suppkey").cast("int").alias("v"))
    x.put("supp", keys)
    x.put("BAL", keys.withColumn("v", F.col("v") * 1.5))
    text = cdl.dump(x.catalog, x.cells, "tables", coordinates=True)
    c, data = cdl.parse(text, 5)
    assert not data.get("BAL")
    return _rows(spark, [(len([v for v in data["supp"] if v is not None]),)], "numbers long")


@_query("diff_datasets", f"select 'QTY' as name, (select count(*) from {_QTY} where v % 10 = 3)::bigint as n_differ union all select 'EVT', 0")
def diff_datasets(spark, d):
    from . import diffing

    a, b = _filled(spark, d), _filled(spark, d)
    b.put("QTY", qty(spark, d).filter("v % 10 = 3").withColumn("v", F.col("v") + 1))
    return diffing.diff(a, b).counts(spark)


@_query("diff_headers", "select * from (values ('differ', 'dimension supp'), ('lacking', 'MORE'), ('skipped', 'QTY: type')) t(state, what)")
def diff_headers(spark, d):
    """Datasets of which one has a longer dimension, another type and another variable."""
    from . import diffing

    a, b = _defined(spark, d), Dataset.create(spark, None, 5)
    b.def_dim("time")
    b.def_dim("supp", _n_supp(spark, d) + 1)
    b.def_dim("line", 8)
    b.def_var("QTY", "short", ["supp", "line"])
    b.def_var("EVT", "double", ["time"])
    b.def_var("MORE", "double", ["time"])
    a.enddef()
    b.enddef()
    report = diffing.diff(a, b)
    rows = [("differ", " ".join(k)) for k, *_ in report.header if k == ("dimension", "supp")]
    rows += [("lacking", n) for n in report.lacking] + [("skipped", f"{n}: {why}") for n, why in report.skipped.items()]
    return _rows(spark, rows, "state string, what string")


@_query("diff_status", f"select 'same' as pair, 0 as status, 0 as lines union all select 'other', 1, 1 union all select 'quiet', 1, 0")
def diff_status(spark, d):
    from . import diffing

    a, b = _filled(spark, d, put=False), _filled(spark, d, put=False)
    same = diffing.status(spark, diffing.diff(a, a))
    b.put("QTY", qty(spark, d).filter("i0 = 3").withColumn("v", F.col("v") + 1))
    report = diffing.diff(a, b, ["QTY"])
    other, quiet = diffing.status(spark, report), diffing.status(spark, report, quiet=True)
    return _rows(spark, [("same", same[0], len(same[1])), ("other", other[0], len(other[1])), ("quiet", quiet[0], len(quiet[1]))], "pair string, status int, lines int")


@_query("subfiles", f"select i0 * 3 // {_N} as file, i0, i1, v from {_QTY}")
def subfiles(spark, d):
    """The dataset in three files, each with its rows of suppliers, opened again as one."""
    from . import subfiles as sub

    folder = f"{_folder(spark)}/parts"
    sub.save(_filled(spark, d, put=False), folder, 3)
    cells = _written(sub.read(spark, folder, "QTY"))
    return cells.select(hyperslab.subfile([_n_supp(spark, d), 8], 3).alias("file"), "i0", "i1", "v")


@_query("subfile_stub", f"select k as file, ((k * {_N} + 2) // 3)::bigint as lo, (((k + 1) * {_N} + 2) // 3)::bigint as hi, 3 as n_files, 0 as rank from (select unnest(range(3)) as k)")
def subfile_stub(spark, d):
    """What the stub and the subfiles say of themselves."""
    from . import subfiles as sub

    folder = f"{_folder(spark)}/parts"
    sub.save(_filled(spark, d, put=False), folder, 3)
    stub = Dataset.open(spark, f"{folder}/{sub.STUB}")
    n, rank = stub.get_att(sub.COUNT, "QTY")[0], stub.inq_var("QTY")["ndims"]
    out = []
    for k in range(n):
        lo, hi = Dataset.open(spark, f"{folder}/{k}.nc").get_att(sub.RANGE, "QTY")
        out.append((k, lo, hi, n, rank))
    return _rows(spark, out, "file int, lo long, hi long, n_files int, rank int")


# --- conversion, names and the rest


@_query("cvt_put_own_fill", f"select i0, i1, (case when v * 3 between -128 and 127 then v * 3 else -9 end)::tinyint as v from {_QTY}")
def cvt_put_own_fill(spark, d):
    """Ints put into a byte variable: what does not fit is stored as the variable's own fill."""
    x = Dataset.create(spark, None, 5)
    x.def_dim("supp", _n_supp(spark, d))
    x.def_dim("line", 8)
    x.def_var("B", "byte", ["supp", "line"])
    x.put_att("_FillValue", [-9], "B", "byte")
    x.enddef()
    x.put("B", qty(spark, d).withColumn("v", F.col("v") * 3), dtype="int")
    return x.get("B")


@_query("cvt_no_fill_on_erange", f"select i0, i1, case when v * 3 between -128 and 127 then (v * 3)::varchar else 'none' end as v from {_QTY}")
def cvt_no_fill_on_erange(spark, d):
    return qty(spark, d).withColumn("v", F.coalesce(cv.convert(F.col("v") * 3, "int", "byte", erange_fill=False).cast("string"), F.lit("none")))


_INTEGERS = ("byte", "short", "int", "ubyte", "ushort", "uint", "int64")


@_query("cvt_matrix", " union all ".join(f"select '{s}' as source, '{t}' as target, coalesce(sum(case when x between {TYPES[t].low} and {TYPES[t].high} then x else {TYPES[t].fill} end), 0)::double as total from (select case when v * 700 - 9000 between {TYPES[s].low} and {TYPES[s].high} then v * 700 - 9000 else {TYPES[s].fill} end as x from {_QTY})" for s in _INTEGERS for t in (*_INTEGERS, "double")))
def cvt_matrix(spark, d):
    """Every integer type read as every other and as double: sums of what comes out."""
    cells = qty(spark, d).select((F.col("v") * 700 - 9000).alias("v"))
    cells = cells.select(*[cv.convert(F.col("v"), "int", s).alias(s) for s in _INTEGERS])
    sums = [F.coalesce(F.sum((F.col(s) if s == t else cv.convert(F.col(s), s, t)).cast("double")), F.lit(0.0)).alias(f"{s} {t}") for s in _INTEGERS for t in (*_INTEGERS, "double")]
    row = cells.agg(*sums)
    pairs = [F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.col(f"{s} {t}").alias("total")) for s in _INTEGERS for t in (*_INTEGERS, "double")]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


@_query("names_checked", f"select n_name as name, 0 as plain, {int(Code.BADNAME)} as slash, {int(Code.BADNAME)} as blank_end, {int(Code.NAMEINUSE)} as again from nation")
def names_checked(spark, d):
    """Names of nations as dimensions, decomposed accents included: normal form C, and what is not a name."""
    x, out = Dataset.create(spark), []
    for (name,) in _read(spark, d, "nation").select("n_name").collect():
        own = name + "é"
        plain = _status(x.def_dim, own, 3)
        assert x.inq_dim(name + "é")[0] == name + "é"
        out.append((name, plain, _status(x.def_dim, name + "/", 3), _status(x.def_dim, name + " ", 3), _status(x.def_dim, name + "é", 3)))
    return _rows(spark, out, "name string, plain int, slash int, blank_end int, again int")


@_query("never_written", f"select g.i0, g.i1, coalesce(q.v, -2147483647) as v from (select i0, i1 from (select unnest(range({_N})) as i0), (select unnest(range(8)) as i1)) g left join {_QTY} q on q.i0 = g.i0 and q.i1 = g.i1")
def never_written(spark, d):
    """Cells of a file that were never written read as fill, also with filling off."""
    return Dataset.open(spark, _file(spark, d)).get("QTY")


@_query("patch_numrecs", "select count(*)::bigint as before, (count(*) // 2)::bigint as after, sum(case when event_id < (select count(*) // 2 from events) then 1 else 0 end)::bigint as records from events")
def patch_numrecs(spark, d):
    """The record count overwritten in a file: readers see as many records."""
    path = _file(spark, d)
    before = cdf.read_header(path).numrecs
    cdf.set_numrecs(path, before // 2)
    y = Dataset.open(spark, path)
    return y.get("EVT").agg(F.lit(before).cast("long").alias("before"), F.lit(y.catalog.numrecs).cast("long").alias("after"), F.count(F.lit(1)).alias("records"))


@_query("dump_selected", f"select 'header' as what, 0::bigint as numbers union all select 'QTY', {_N} * 8 union all select 'EVT', count(*) from events")
def dump_selected(spark, d):
    """Dumps of the header alone and of one variable each, in lines of 60 characters: how many numbers they hold."""
    x = _filled(spark, d)
    out = []
    for what, how in (("header", {"header": True}), ("QTY", {"only": ["QTY"]}), ("EVT", {"only": ["EVT"]})):
        text = cdl.dump(x.catalog, {"QTY": x.filled("QTY"), "EVT": x.get("EVT")}, "tables", width=60, **how)
        data = text.partition("data:")[2]
        assert max(map(len, data.split("\n"))) <= 62 and "int QTY(supp, line)" in text
        out.append((what, data.count(",") + (1 if "=" in data else 0)))
    return _rows(spark, out, "what string, numbers long")


@_query("inq_var_fill", f"select 'QTY' as name, 1 as no_fill, -2147483647::double as fill union all select 'EVT', 0, max(user_id)::double from events")
def inq_var_fill(spark, d):
    x = _defined(spark, d)
    x.def_var_fill("EVT", False, float(_read(spark, d, "events").agg(F.max("user_id")).first()[0]))
    return _rows(spark, [(n, int(x.inq_var(n)["no_fill"]), float(x.inq_var(n)["fill"])) for n in ("QTY", "EVT")], "name string, no_fill int, fill double")


@_query("statuses", "select * from (values (-40, 'an index is beyond its dimension'), (-57, 'start and count reach beyond a dimension'), (-58, 'a stride is not positive'), (-210, 'a count is negative'), (-49, 'no such variable')) t(status, text)")
def statuses(spark, d):
    """Requests for cells that are not there, and what their statuses say."""
    from ..functions.types import message

    x, n = _filled(spark, d, put=False), _n_supp(spark, d)
    asked = (([n, 0], [1, 1], None), ([n - 1, 0], [2, 1], None), ([0, 0], [1, 1], [0, 1]), ([0, 0], [-1, 1], None))
    codes = [_status(x.get, "QTY", *a) for a in asked] + [_status(x.get, "NONE")]
    return _rows(spark, [(k, message(k)) for k in codes], "status int, text string")


@_query("files_opened", f"select 5 as version, 2 as opened, 0 as closed, {_N}::bigint as size")
def files_opened(spark, d):
    path, before = _file(spark, d), len(ds.inq_files_opened())
    x, y = Dataset.open(spark, path), Dataset.open(spark, path)
    opened, size = len(ds.inq_files_opened()) - before, x.inq_dim("supp")[1]
    assert ds.inq_libvers() and x.inq()["path"] == path
    x.close()
    y.close()
    return _rows(spark, [(x.inq()["version"], opened, len(ds.inq_files_opened()) - before, size)], "version int, opened int, closed int, size long")
