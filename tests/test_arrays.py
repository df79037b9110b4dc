"""Types, catalogue, selections, updates, deferred requests, comparison, files, CDL and streams."""

import math
import random
import struct
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import convert as cv
from gridloom.functions.types import TYPES, ArrayError, Code, checked_name
from gridloom.operators import compare, hyperslab, requests, update
from gridloom.plans.catalog import Att, Catalog
from gridloom.plans.dataset import ALL_GETS, Dataset, inq_default_format, set_default_format
from gridloom.sources import cdf, cdl


def code_of(f, *args, **how):
    with pytest.raises(ArrayError) as e:
        f(*args, **how)
    return e.value.code


def value(kind, index):
    """The generating rule of test values: limits and their neighbours first, then a polynomial of the index."""
    t = TYPES[kind]
    if len(index) == 1 and index[0] < 2 and kind not in ("char",):
        return [t.low, t.high][index[0]]
    base = {"byte": -2, "short": -5, "int": -20, "float": -9, "double": -10, "ubyte": 2, "ushort": 5, "uint": 20, "int64": -20, "uint64": 20}[kind]
    v = base * (len(index) + 1)
    for i in index:
        v = base * (v + i)
    return max(t.low, min(t.high, v))


def test_names_and_types():
    assert checked_name("é") == "é"
    for bad in ("", "a/b", "a ", " a", "a\nb", "-a"):
        assert code_of(checked_name, bad) == Code.BADNAME
    assert code_of(checked_name, "a" * 257) == Code.MAXNAME
    assert len({t.code for t in TYPES.values()}) == 11


def test_definition_errors():
    c = Catalog(1)
    c.def_dim("t", 0)
    c.def_dim("x", 3)
    assert code_of(c.def_dim, "u", 0) == Code.UNLIMIT
    assert code_of(c.def_dim, "x", 4) == Code.NAMEINUSE
    assert code_of(c.def_dim, "big", 2**31) == Code.DIMSIZE
    assert code_of(c.def_var, "a", "uint64", ["x"]) == Code.STRICTCDF2
    assert code_of(c.def_var, "a", "int", ["x", "t"]) == Code.UNLIMPOS
    assert code_of(c.def_var, "a", "int", [7]) == Code.BADDIM
    assert code_of(c.def_var, "a", "real", ["x"]) == Code.BADTYPE
    c.def_var("a", "int", ["x"])
    assert code_of(c.def_var, "a", "int", ["x"]) == Code.NAMEINUSE
    large = Catalog(1)
    large.def_dim("n", 2**31 - 1)
    large.def_var("a", "int", ["n"])
    large.check_sizes()  # the last variable may be large
    large.def_var("b", "int", ["n"])
    assert code_of(large.check_sizes) == Code.VARSIZE


@pytest.mark.parametrize(
    ("start", "count", "stride", "how", "code"),
    [
        (None, [1], None, {}, Code.INVALCOORDS), ([-1, 0], [1, 1], None, {}, Code.INVALCOORDS), ([4, 0], [1, 1], None, {}, Code.INVALCOORDS),
        ([4, 0], [0, 1], None, {"relaxed": False}, Code.INVALCOORDS), ([5, 0], [0, 1], None, {}, Code.INVALCOORDS), ([0, 0], None, None, {}, Code.EDGE),
        ([0, 0], [-1, 1], None, {}, Code.NEGATIVECNT), ([0, 0], [5, 1], None, {}, Code.EDGE), ([0, 0], [2, 2], [1, 6], {}, Code.EDGE),
        ([0, 0], [1, 1], [0, 1], {}, Code.STRIDE), ([0, 0], [1, 1], None, {"record": True, "shape": [0, 6]}, Code.INVALCOORDS),
    ],
)
def test_index_errors(start, count, stride, how, code):
    shape = how.pop("shape", [4, 6])
    assert code_of(hyperslab.validate, shape, start, count, stride, **how) == code


def test_index_allowed():
    hyperslab.validate([4, 6], [4, 0], [0, 1])
    hyperslab.validate([0, 6], [100, 0], [3, 6], record=True, write=True)
    hyperslab.validate([4, 6], [1, 0], [2, 3], [2, 2])
    hyperslab.validate([], None, None)


def cells(spark, shape, kind="int"):
    rows = [(*map(int, i), int(np.ravel_multi_index(i, shape))) for i in np.ndindex(*shape)]
    return spark.createDataFrame(rows, ", ".join([f"i{k} long" for k in range(len(shape))] + [f"v {kind}"]))


def test_hyperslabs_against_numpy(spark):
    shape = (7, 5, 6)
    a, df, r = np.arange(210).reshape(shape), None, random.Random(1)
    df = cells(spark, shape).cache()
    for _ in range(12):
        start = [r.randrange(n) for n in shape]
        stride = [r.randrange(1, 4) for _ in shape]
        count = [r.randrange(1, (n - s + t - 1) // t + 1) for n, s, t in zip(shape, start, stride, strict=True)]
        want = a[tuple(slice(s, s + c * t, t) for s, c, t in zip(start, count, stride, strict=True))]
        hyperslab.validate(shape, start, count, stride)
        got = hyperslab.get_varm(df, start, count, stride, [1, count[0], count[0] * count[1]]).collect()
        assert sorted(x.v for x in got) == sorted(want.ravel())
        memory = {x.address: x.v for x in got}
        assert [memory[k] for k in range(want.size)] == want.transpose().ravel().tolist()
    got = hyperslab.get_varn(df, [([0, 0, 0], [1, 1, 2]), ([0, 0, 1], None), ([0, 0, 0], [1, 1, 2])])
    assert sorted((x.box, x.v) for x in got.collect()) == [(0, 0), (0, 1), (1, 1), (2, 0), (2, 1)]


def test_conversion_rule(spark):
    """Every type to every other, over limits, their neighbours and specials: fill out of range, truncation within."""
    for source in ("short", "int", "int64", "float", "double"):
        t = TYPES[source]
        values = [t.low, t.high, 0, 1, -1, 127, 128, 255, 256, -129] + ([2.9, -2.9, float("nan"), float("inf"), -float("inf"), 65535.5, 1e20] if source in ("float", "double") else [])
        if source == "short":
            values = [v for v in values if -(2**15) <= v < 2**15]
        values = [float(v) for v in values] if source in ("float", "double") else values
        df = spark.createDataFrame([(v,) for v in values], "v double" if source == "double" else "v " + {"short": "short", "int": "int", "int64": "long", "float": "float"}[source])
        for target, o in TYPES.items():
            if target in ("char", source):
                continue
            got = [r[0] for r in df.select(cv.convert(F.col("v"), source, target)).collect()]
            for v, g in zip(values, got, strict=True):
                v = float(np.float32(v)) if source == "float" else v
                if target in ("float", "double"):
                    if v != v:
                        assert math.isnan(g)
                    elif abs(v) > o.high:
                        assert g == o.fill
                    else:
                        assert g == (float(np.float32(v)) if target == "float" else float(v))
                elif v != v or math.isinf(v) or not o.low <= v < o.high + 1 and not o.low <= v <= o.high or v > o.high:
                    assert g == o.fill, (source, target, v, g)
                else:
                    assert g == int(v), (source, target, v, g)


def test_conversion_forbidden_and_wraps(spark):
    assert code_of(cv.convert, F.lit(1), "char", "int") == Code.CHAR
    df = spark.createDataFrame([(k,) for k in (0, 127, 128, 255)], "v int")
    assert [r[0] for r in df.select(cv.wrap_uchar(F.col("v"))).collect()] == [0, 127, -128, -1]
    assert [r[0] for r in df.select(cv.unwrap_uchar(cv.wrap_uchar(F.col("v")))).collect()] == [0, 127, 128, 255]


def test_update_and_fill(spark):
    old, new = cells(spark, (3, 4)), cells(spark, (2, 2)).withColumn("v", F.col("v") + 100)
    got = {(r.i0, r.i1): r.v for r in update.put(old, new).collect()}
    assert got[0, 0] == 100 and got[1, 1] == 103 and got[2, 3] == 11 and len(got) == 12
    nulls = update.put(old, new.withColumn("v", F.lit(None).cast("int")))
    assert nulls.filter("v is null").count() == 4  # a written null is not the old value
    sparse = old.filter("i1 = 0")
    dense = {(r.i0, r.i1): r.v for r in update.densify(sparse, [3, 4], "int").collect()}
    assert len(dense) == 12 and dense[1, 0] == 4 and dense[1, 1] == TYPES["int"].fill
    assert cv.with_nulls(update.densify(sparse, [3, 4], "int"), "v", "int").filter("v is null").count() == 9


def test_coalesce_and_flatten(spark):
    rows = [(0, 4), (4, 4), (20, 2), (6, 4), (21, 9), (40, 1)]
    got = requests.coalesce_ranges(spark.createDataFrame(rows, "off long, len long"))
    assert sorted(map(tuple, got.collect())) == [(0, 10), (20, 10), (40, 1)]
    flat = requests.flatten(cells(spark, (2, 3)), 2, requests.element_offset(8, [2, 3], 4), 4)
    assert sorted(map(tuple, flat.collect())) == [(0, 8, 12), (1, 20, 12)]


def test_diff(spark):
    nan = float("nan")
    a = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 2.0, nan, 0.0, 100.0])], "i0 long, v double")
    b = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 2.5, nan, 0.0, 101.0])], "i0 long, v double")
    assert sorted(r.i0 for r in compare.diff(a, b).collect()) == [1, 2, 4]
    assert sorted(r.i0 for r in compare.diff(a, b, 0.1, 0.02).collect()) == [1, 2]
    assert compare.first_diff(a, b).first().i0 == 1


def dataset(spark, path=None, version=5):
    d = Dataset.create(spark, path, version)
    d.def_dim("t")
    d.def_dim("y", 2)
    d.def_dim("x", 3)
    for kind in TYPES:
        if version == 5 or kind in ("byte", "char", "short", "int", "float", "double"):
            d.def_var(f"f_{kind}", kind, ["y", "x"])
            d.def_var(f"r_{kind}", kind, ["t", "x"])
    d.def_var("scalar", "double", [])
    d.put_att("title", 'a "b"\n')
    d.put_att("range", [1, 2], "f_int")
    d.put_att("scale", [0.5, 2.0], "r_float", "float")
    d.enddef()
    return d


def spark_value(kind, v):
    return bytearray([v % 128]) if kind == "char" else Decimal(v) if kind == "uint64" else float(v) if kind in ("float", "double") else v


@pytest.mark.parametrize("version", [1, 2, 5])
def test_file_round_trip(spark, tmp_path, version):
    path = str(tmp_path / "a.nc")
    d = dataset(spark, path, version)
    want = {}
    for v in d.catalog.vars:
        if not v.dims:
            d.put("scalar", spark.createDataFrame([(2.5,)], "v double"))
            continue
        rows = [(i, j, spark_value(v.xtype, value(v.xtype, (i, j)) if v.xtype != "char" else i * 3 + j + 60)) for i in range(2) for j in range(3)]
        want[v.name] = sorted(map(tuple, spark.createDataFrame(rows, d.cells[v.name].schema).collect()))
        d.put(v.name, spark.createDataFrame(rows, d.cells[v.name].schema))
    d.close()
    assert cdf.sniff_path(path) == f"CDF-{version}" and cdf.validate(path) == []
    e = Dataset.open(spark, path)
    assert e.catalog.numrecs == 2 and e.get_att("title") == 'a "b"\n' and e.get_att("range", "f_int") == [1, 2] and e.get_att("range", "f_int", "double") == [1.0, 2.0]
    for name, rows in want.items():
        assert sorted(map(tuple, e.get(name).collect())) == rows, name
    assert e.get("scalar").first().v == 2.5
    box = e.get("r_int", [1, 1], [1, 2])
    assert sorted((r.i0, r.i1) for r in box.collect()) == [(1, 1), (1, 2)]
    text = cdl.dump(e.catalog, e.cells, "a")
    c, data = cdl.parse(text, version)
    assert [(v.name, v.xtype, v.dims) for v in c.vars] == [(v.name, v.xtype, v.dims) for v in e.catalog.vars] and c.numrecs == 2
    again = cdl.frames(spark, c, data)
    for name, rows in want.items():
        if "float" not in name and "double" not in name:
            assert sorted(map(tuple, again[name].collect())) == rows, name
    assert cdf.encode_header(cdf.read_header(path)) == cdf.encode_header(e.catalog)


def test_single_record_variable_is_not_padded(spark, tmp_path):
    path = str(tmp_path / "one.nc")
    with Dataset.create(spark, path) as d:
        d.def_dim("t")
        d.def_dim("c", 3)
        d.def_var("b", "byte", ["t", "c"])
        d.enddef()
        d.put("b", cells(spark, (5, 3), "byte"))
    assert d.catalog.recsize() == 3
    assert [r.v for r in Dataset.open(spark, path).get("b").orderBy("i0", "i1").collect()] == list(range(15))


def test_corrupt_headers(spark, tmp_path):
    path = str(tmp_path / "a.nc")
    dataset(spark, path, 1).close()
    good = open(path, "rb").read()[: 1 << 14]
    cdf.decode_header(good)
    assert code_of(cdf.decode_header, b"CDF\x03" + good[4:]) == Code.NOTNC
    assert code_of(cdf.decode_header, good[:40]) == Code.NOTNC
    c = cdf.decode_header(good)
    c.vars[0].begin = 8
    assert code_of(cdf.decode_header, cdf.encode_header(c)) == Code.NOTNC
    raw = bytearray(good)
    at = raw.index(b"f_byte") + 8  # rank and dimension ids follow the padded name
    raw[at + 4 : at + 8] = struct.pack(">I", 77)
    assert code_of(cdf.decode_header, bytes(raw)) == Code.BADDIM
    raw = bytearray(good)
    at = raw.index(b"title") + 8
    raw[at : at + 4] = struct.pack(">i", 99)
    assert code_of(cdf.decode_header, bytes(raw)) == Code.BADTYPE
    raw = bytearray(good)
    raw[raw.index(b"title") + 5] = 1  # padding
    cdf.decode_header(bytes(raw))
    assert code_of(cdf.decode_header, bytes(raw), True) == Code.NULLPAD
    assert cdf.sniff(b"\x89HDF\r\n\x1a\n") == "HDF5" and cdf.sniff(b"plain") == "unknown"


def test_modes_and_attributes(spark):
    d = dataset(spark)
    assert code_of(d.def_dim, "z", 1) == Code.NOTINDEFINE
    assert code_of(d.put_att, "new", 1) == Code.NOTINDEFINE
    assert d.put_att("range", [300, 7], "f_int") == 0
    assert code_of(d.put_att, "range", [1, 2, 3], "f_int") == Code.NOTINDEFINE
    d.rename_var("f_int", "fint")
    assert code_of(d.rename_var, "fint", "a_longer_name") == Code.NOTINDEFINE
    d.redef()
    assert code_of(d.get, "fint") == Code.INDEFINE
    d.rename_att("range", "valid_range", "fint")
    assert d.inq_att("valid_range", "fint")["len"] == 2
    assert d.put_att("b", [1000, 5], "f_byte", "byte") == 1 and d.get_att("b", "f_byte") == [-127, 5]
    assert code_of(d.put_att, "_FillValue", 1.5, "fint", "double") == Code.BADTYPE
    d.copy_att("title", None, d, "f_byte")
    d.del_att("title")
    assert code_of(d.get_att, "title") == Code.NOTATT
    d.enddef()
    assert code_of(d.get, "fint", collective=False) == Code.NOTINDEP
    d.begin_indep_data()
    assert code_of(d.get, "fint", collective=True) == Code.INDEP
    d.end_indep_data()
    assert code_of(d.get, "f_char", dtype="int") == Code.CHAR and code_of(d.get, "nothing") == Code.NOTVAR
    assert code_of(d.put_vard) == Code.NOTSUPPORT
    assert set_default_format(5) == 1 and inq_default_format() == 5 and set_default_format(1) == 5
    q = d.inq()
    assert (q["ndims"], q["unlimdim"], q["num_rec_vars"], q["num_fix_vars"]) == (3, 0, 11, 12)
    assert d.atts().filter("name = 'valid_range'").first().n == 2


def test_fill_modes(spark):
    d = Dataset.create(spark)
    d.def_dim("t")
    d.def_dim("x", 2)
    assert d.set_fill(True) is False
    d.def_var("a", "int", ["x"])
    d.def_var("r", "short", ["t", "x"])
    d.def_var("n", "int", ["t"])
    d.def_var_fill("r", False, -9)
    d.def_var_fill("n", True)
    d.enddef()
    assert [r.v for r in d.get("a").collect()] == [TYPES["int"].fill] * 2
    d.fill_var_rec("r", 2)
    assert d.catalog.numrecs == 3 and [r.v for r in d.get("r").collect()] == [-9, -9]
    assert [r.v for r in d.with_nulls("r").collect()] == [None, None]
    assert code_of(d.fill_var_rec, "a", 0) == Code.NOTRECVAR and code_of(d.fill_var_rec, "n", 0) == Code.NOTFILL


def test_requests_writes_before_reads(spark):
    d = dataset(spark)
    one = spark.createDataFrame([(0, 0, 5)], "i0 long, i1 long, v int")
    get = d.iget("f_int")
    put = d.iput("f_int", one)
    put2 = d.iput("f_int", one.withColumn("v", F.lit(6)))
    assert get % 2 == 1 and put % 2 == 0 and d.inq()["nreqs"] == 3
    out = d.wait()
    assert out[get].first().v == 6 and put2 > put and d.inq()["nreqs"] == 0
    assert code_of(d.bput, "f_int", one) == Code.NULLABUF
    assert code_of(d.buffer_attach, 0) == Code.NULLBUF
    d.buffer_attach(8)
    assert code_of(d.buffer_attach, 8) == Code.PREVATTACHBUF
    d.bput("f_int", one)
    d.bput("f_int", one)
    assert code_of(d.bput, "f_int", one) == Code.INSUFFBUF and code_of(d.buffer_detach) == Code.PENDINGBPUT
    assert d.wait(ALL_GETS) == {} and d.inq()["buffer_usage"] == 8
    assert code_of(d.wait, [99]) == Code.INVAL_REQUEST
    d.cancel()
    d.buffer_detach()
    d.iget("f_int")
    assert code_of(d.close) == Code.PENDING


def test_cdl_rules():
    c, data = cdl.parse('netcdf a { dimensions: t = UNLIMITED, x = 2; variables: int v(t, x); v:a = 1b, 2b; double w; float q(x); data: v = 1, 2, 3; q = NaN, _; w = 3000000000; }')
    assert c.numrecs == 2 and data["v"] == [1, 2, 3, None] and data["q"][0] == float(np.float32(TYPES["float"].fill)) and data["q"][1] is None and data["w"] == [3e9]
    assert c.var("v").atts == [Att("a", "byte", [1, 2])]
    assert code_of(cdl.parse, "netcdf a { dimensions: x = 2; variables: int v(x); data: v = 1, 2, 3; }") == Code.EDGE
    assert code_of(cdl.parse, "netcdf a { dimensions: x = 0; }") == Code.DIMSIZE
    assert code_of(cdl.parse, "netcdf a { variables: int v; v:a = 1, 2.5; }") == Code.BADTYPE
    assert code_of(cdl.parse, "netcdf a { variables: int v; v:a = 1; v:a = 2; }") == Code.NAMEINUSE
    for suffix, kind in (("ub", "ubyte"), ("us", "ushort"), ("u", "uint"), ("ll", "int64"), ("ull", "uint64"), ("s", "short"), ("f", "float")):
        assert cdl.constant("7" + suffix) == (kind, 7)
    assert cdl.number(0.1, "double") == "0.1" and cdl.number(float(np.float32(0.1)), "float") == "0.1"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_cdl_strings_round_trip(text):
    text = "".join(x for x in text if x != "\0" and not 0xD800 <= ord(x) < 0xE000)
    c = Catalog(1)
    c.atts.append(Att("a", "char", text))
    back, _ = cdl.parse(cdl.dump_header(c) + "}")
    assert back.atts[0].values == text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=8), st.sampled_from([1, 2, 5]))
def test_header_codec(sizes, version):
    c = Catalog(version)
    c.def_dim("t", 0)
    for k, (n, m) in enumerate(sizes):
        c.def_dim(f"d{k}", m)
        c.def_var(f"v{k}", ["byte", "short", "int", "double"][n % 4], (["t"] if n % 3 == 0 else []) + [f"d{k}"])
        c.vars[-1].atts.append(Att("k", "short", list(range(n % 5))))
    c.lay_out()
    raw = cdf.encode_header(c)
    assert cdf.encode_header(cdf.decode_header(raw, strict=True)) == raw


def test_record_stream_and_log(spark, tmp_path):
    from gridloom.streaming.records import RecordStream, WriteLog

    path = str(tmp_path / "s.nc")
    with Dataset.create(spark, path) as d:
        d.def_dim("t")
        d.def_var("a", "int", ["t"])
        d.enddef()
        d.put("a", cells(spark, (5,)))
    spark.dataSource.register(RecordStream)

    def run():
        q = spark.readStream.format("cdf_records").option("path", path).option("var", "a").load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [0, 1, 2, 3, 4]
    e = Dataset.open(spark, path, write=True)
    e.cells["a"] = spark.createDataFrame(e.cells["a"].collect(), e.cells["a"].schema)
    e.put("a", spark.createDataFrame([(5, 50), (6, 60)], "i0 long, v int"))
    e.close()
    assert run() == [0, 1, 2, 3, 4, 50, 60]
    log = WriteLog(spark, str(tmp_path / "log"))
    log.put("a", cells(spark, (3,)))
    log.put("a", spark.createDataFrame([(1, 9)], "i0 long, v int"))
    out = log.flush({"a": spark.createDataFrame([], "i0 long, v int")})["a"]
    assert sorted(map(tuple, out.collect())) == [(0, 0), (1, 9), (2, 2)]
    assert code_of(log.cancel, 0) == Code.FLUSHED and log.calls().count() == 2


def merged(rows):
    """Ranges merged one after the other."""
    out = []
    for off, n in sorted(rows):
        if out and off <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], off + n - out[-1][0])
        else:
            out.append([off, n])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("spread", [40, 4000])
def test_ranges_over_many_parts(spark, monkeypatch, spread):
    """Islands that reach over several parts, equal offsets, and files apart; pieces for requests; ranks."""
    monkeypatch.setattr(requests, "PART_RANGES", 10)
    r = random.Random(spread)
    rows = [(r.randrange(3), r.randrange(spread) * 4, r.choice([4, 8, 8, 60, 400])) for _ in range(400)]
    df = spark.createDataFrame(rows, "file long, off long, len long")
    got = [tuple(x) for x in requests.coalesce_ranges(df, "file").collect()]
    assert sorted(got) == sorted((f, *x) for f in range(3) for x in merged([x[1:] for x in rows if x[0] == f]))
    one = requests.coalesce_ranges(df.drop("file"))
    assert sorted(map(tuple, one.collect())) == merged([x[1:] for x in rows])
    ranked = requests.merge_sorted([df.filter("file = 0").drop("file"), df.filter("file > 0").drop("file")]).orderBy("rank").collect()
    assert [x["rank"] for x in ranked] == list(range(1, 401)) and [(x.off, x.len) for x in ranked] == sorted(x[1:] for x in rows)
    asked = [(k, r.randrange(spread * 4), r.randrange(0, 90)) for k in range(60)]
    want = sorted((k, max(o, a), min(o + n, a + m) - max(o, a)) for k, a, m in asked for o, n in merged([x[1:] for x in rows]) if max(o, a) < min(o + n, a + m))
    pieces = requests.scatter(one, spark.createDataFrame(asked, "req long, off long, len long"), cell=64)
    assert sorted(map(tuple, pieces.collect())) == want


def test_ranges_empty(spark):
    none = spark.createDataFrame([], "off long, len long")
    assert requests.coalesce_ranges(none).count() == 0 and requests.merge_sorted([none, none]).count() == 0


def test_many_boxes(spark, monkeypatch):
    df, r = cells(spark, (40, 30)), random.Random(5)
    boxes = [([(s := r.randrange(40)), (t := r.randrange(30))], [r.randrange(0, 41 - s), r.randrange(0, 31 - t)]) for _ in range(50)]
    want = sorted((b, i, j) for b, (s, c) in enumerate(boxes) for i in range(s[0], s[0] + c[0]) for j in range(s[1], s[1] + c[1]))
    for most in (0, 1000):
        monkeypatch.setattr(hyperslab, "BROADCAST_BOXES", most)
        assert sorted((x.box, x.i0, x.i1) for x in hyperslab.get_varn(df, boxes).collect()) == want
    assert hyperslab.get_varn(df, []).count() == 0


def test_record_growth(spark):
    d = dataset(spark)
    row = lambda i, v: spark.createDataFrame([(i, x, v) for x in range(3)], "i0 long, i1 long, v int")
    d.put("r_int", row(0, 1))  # the first record alone
    assert d.catalog.numrecs == 1
    d.put("r_int", row(1, 2), [1, 0], [1, 3])
    d.put("r_int", row(1, 3), [1, 0], [1, 3])
    d.put("r_int", row(9, 3), [9, 0], [1, 0])  # an empty box
    assert d.catalog.numrecs == 2 and sorted((x.i0, x.v) for x in d.get("r_int").collect()) == [(0, 1)] * 3 + [(1, 3)] * 3
    d.mput({"r_int": {"cells": row(2, 4), "start": [2, 0], "count": [1, 3]}, "f_int": {"cells": row(1, 5)}})
    assert d.catalog.numrecs == 3 and d.get("f_int", [1, 2]).first().v == 5


def test_deferred_box_lists(spark):
    d = dataset(spark)
    batch = spark.createDataFrame([(1, 3, 1, 0, 8), (0, 4, 1, 0, 9), (0, 0, 0, 0, 7)], "box long, start_offset long, i0 long, i1 long, v int")
    get = d.iget_varn("f_int", [([0, 0], [2, 1]), ([1, 0], None)])
    d.iput_varn("f_int", batch)
    assert sorted((x.box, x.v) for x in d.wait()[get].collect()) == [(0, 7), (0, 8), (1, 8)]
    assert code_of(d.bput_varn, "f_int", batch) == Code.NULLABUF
    d.buffer_attach(12)
    d.bput_varn("f_int", batch)
    assert d.inq()["buffer_usage"] == 12
    d.wait_all()


def test_dataset_diff(spark):
    from gridloom.plans.diffing import diff

    a, b = dataset(spark), dataset(spark)
    assert diff(a, b).same(spark)
    one = spark.createDataFrame([(1, 1, 5)], "i0 long, i1 long, v int")
    a.put("f_int", one)
    b.put("f_int", one.withColumn("v", F.lit(6)))
    c = spark.createDataFrame([(0, 0, bytearray(b"x"))], "i0 long, i1 long, v binary")
    a.put("f_char", c)
    found = diff(a, b)
    assert not found.header and {x.name: x.n_differ for x in found.counts(spark).collect() if x.n_differ} == {"f_int": 1, "f_char": 1} and not found.same(spark)
    assert "r_int" not in found.cells  # no records
    assert diff(a, b, ["f_int"], absolute=1.0).same(spark)
    b.redef()
    b.put_att("title", "other")
    b.def_var("more", "int", ["x"])
    b.enddef()
    found = diff(a, b)
    assert found.lacking == ["more"] and [k[:2] for k, *_ in found.header] == [("nvars",), ("attribute", ""), ("variable", "more")]


def test_subfile_requests(spark):
    r = random.Random(9)
    for size, n in ((10, 3), (7, 7), (100, 6)):
        rows = [(k, (s := r.randrange(size)), r.randrange(0, size - s + 1)) for k in range(20)]
        got = requests.subfile_requests(spark.createDataFrame(rows, "req long, start long, count long"), size, n).collect()
        want = sorted((k, i * n // size, i) for k, s, c in rows for i in range(s, s + c))
        assert sorted((x.req, x.file_id, i) for x in got for i in range(x.start, x.start + x["count"])) == want


def test_put_beyond_the_box_and_mapped(spark):
    d = dataset(spark)
    cell = lambda i, j, v: spark.createDataFrame([(i, j, v)], "i0 long, i1 long, v int")
    d.put("f_int", cell(0, 0, 1), [0, 0], [1, 1])
    d.put("f_int", cell(5, 0, 1), [0, 0], [2, 3])
    with pytest.raises(Exception, match="EDGE"):
        d.get("f_int").collect()
    d = dataset(spark)
    d.put("f_int", spark.createDataFrame([(i, j, 10 * i + j) for i in range(2) for j in range(3)], "i0 long, i1 long, v int"))
    memory = spark.createDataFrame([(k, 100 + k) for k in range(6)], "address long, v int")
    d.put("f_int", memory, [0, 0], [2, 3], imap=[1, 2])  # column by column
    assert sorted(map(tuple, d.get("f_int").collect())) == [(i, j, 100 + i + 2 * j) for i in range(2) for j in range(3)]
    back = d.get("f_int", [0, 0], [2, 3], imap=[1, 2])
    assert sorted((x.address, x.v) for x in back.collect()) == [(k, 100 + k) for k in range(6)]
    d.put("f_int", memory.filter("address < 2"), [0, 0], [2, 2], [1, 2], imap=[0, 1], dtype="int")  # one address for two cells
    assert sorted(map(tuple, d.get("f_int").collect())) == [(0, 0, 100), (0, 1, 102), (0, 2, 101), (1, 0, 100), (1, 1, 103), (1, 2, 101)]
    assert code_of(d.put, "f_int", memory, imap=[1, 2]) == Code.INVALCOORDS


def test_put_box_moves_only_the_box(spark, monkeypatch):
    old = spark.range(4000).select((F.col("id") / 50).cast("long").alias("i0"), (F.col("id") % 50).alias("i1"), F.col("id").alias("v"))
    new = spark.range(12).select((2 + F.col("id") / 4 * 3).cast("long").alias("a"), F.col("id")).select((2 + F.floor(F.col("id") / 4) * 3).alias("i0"), (1 + F.col("id") % 4).alias("i1"), (-F.col("id")).alias("v"))
    for bound in (update.BROADCAST_CELLS, 0):
        monkeypatch.setattr(update, "BROADCAST_CELLS", bound)
        got = update.put_box(old, new, [2, 1], [3, 4], [3, 1])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, update.put(old, new).collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not bound or "Exchange hashpartitioning" not in plan


def test_in_place_update(spark, tmp_path):
    path = str(tmp_path / "a.nc")
    d = dataset(spark, path, 5)
    whole = lambda k: spark.createDataFrame([(i, j, k + 10 * i + j) for i in range(2) for j in range(3)], "i0 long, i1 long, v int")
    d.put("f_int", whole(0))
    d.put("r_int", whole(100))
    d.close()
    before, inode = open(path, "rb").read(), __import__("os").stat(path).st_ino
    e = Dataset.open(spark, path, write=True)
    own = e.get("f_int", [1, 1], [1, 2])
    e.put("f_int", own.withColumn("v", F.col("v") + 1000), [1, 1], [1, 2])  # computed from the file itself
    e.put("r_int", spark.createDataFrame([(3, 1, 7)], "i0 long, i1 long, v int"), [3, 1], [1, 1])
    e.rename_var("f_int", "f_in")
    e.put_att("title", "ab")
    assert sorted(x.v for x in e.get("f_in").collect()) == [0, 1, 2, 10, 1011, 1012]
    e.close()
    after = open(path, "rb").read()
    assert __import__("os").stat(path).st_ino == inode and cdf.validate(path) == []
    c = cdf.read_header(path)
    v = c.var("f_in")
    changed = [k for k in range(v.begin, len(before)) if before[k] != after[k]]
    assert changed and all(v.begin + 16 <= k < v.begin + 24 for k in changed)
    f = Dataset.open(spark, path)
    assert f.catalog.numrecs == 4 and f.get_att("title") == "ab" and sorted(x.v for x in f.get("f_in").collect()) == [0, 1, 2, 10, 1011, 1012]
    records = {(x.i0, x.i1): x.v for x in f.get("r_int").collect()}
    assert records[1, 2] == 112 and records[3, 1] == 7 and records[2, 0] == records[3, 2] == TYPES["int"].fill
    assert {x.v for x in f.get("r_double", [2, 0], [2, 3]).collect()} == {TYPES["double"].fill}  # new records are filled
    g = Dataset.open(spark, path, write=True)
    g.put("f_in", whole(5))
    assert g.sync() == 4 and sorted(x.v for x in Dataset.open(spark, path).get("f_in").collect()) == [5, 6, 7, 15, 16, 17]  # durable before it is closed
    g.redef()
    g.def_var("more", "short", ["x"])
    g.enddef()
    g.put("more", spark.createDataFrame([(k, k) for k in range(3)], "i0 long, v short"))
    g.close()
    h = Dataset.open(spark, path)
    assert sorted(x.v for x in h.get("f_in").collect()) == [5, 6, 7, 15, 16, 17] and sorted(x.v for x in h.get("more").collect()) == [0, 1, 2]
    assert {(x.i0, x.i1): x.v for x in h.get("r_int").collect()} == records and [p.name for p in tmp_path.iterdir()] == ["a.nc"]


def test_burst_log(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.nc")
    d = Dataset.create(spark, path, hints={"nc_burst_buf": "enable", "nc_burst_buf_dirname": str(tmp_path), "nc_burst_buf_flush_buffer_size": "8"})
    d.def_dim("t")
    d.def_dim("x", 3)
    d.def_var("a", "int", ["x"])
    d.def_var("r", "int", ["t", "x"])
    d.enddef()
    one = lambda k, v: spark.createDataFrame([(k, v)], "i0 long, v int")
    for k, v in ((0, 1), (1, 2), (0, 3)):
        d.put("a", one(k, v), [k], [1])
    d.put("r", spark.createDataFrame([(1, 2, 9)], "i0 long, i1 long, v int"), [1, 2], [1, 1])
    assert d.cells["a"].count() == 0 and d._log.flushed == 0 and d.catalog.numrecs == 2  # nothing is applied yet
    calls = [x.call for x in d._log.calls().orderBy("seq").collect()]
    assert calls[0] == "put_vara(a, start [0], count [1], stride -): 1 cells" and calls[3].startswith("put_vara(r, start [1, 2], count [1, 1]")
    rounds = []
    own = d._log.rounds
    monkeypatch.setattr(d._log, "rounds", lambda: (rounds.append(sorted(x)) or x for x in own()))
    assert sorted(map(tuple, d.get("a").collect())) == [(0, 3), (1, 2)]
    assert rounds == [["a"], ["a", "r"]]  # eight bytes a round
    assert code_of(d._log.cancel, 0) == Code.FLUSHED
    d.put("a", one(2, 4))
    get = d.iget("a")
    d.iput("a", one(1, 8))
    assert sorted(map(tuple, d.wait()[get].collect())) == [(0, 3), (1, 8), (2, 4)]
    d.put("a", one(0, 11))
    d.close()
    e = Dataset.open(spark, path)
    assert sorted(map(tuple, e.get("a").collect())) == [(0, 11), (1, 8), (2, 4)] and e.get("r", [1, 2], [1, 1]).first().v == 9
    assert [p.name for p in tmp_path.iterdir()] == ["a.nc"]


def test_hints_texts_and_drivers(spark, tmp_path, monkeypatch):
    from gridloom.functions.types import message
    from gridloom.plans import dataset as ds

    def begins(hints, **align):
        d = Dataset.create(spark, hints=hints)
        d.def_dim("t")
        d.def_dim("x", 3)
        d.def_var("a", "int", ["x"])
        d.def_var("r", "int", ["t"])
        d.enddef(**align)
        return d.inq_var("a")["offset"], d.inq_var("r")["offset"], d

    assert begins(None)[:2] == (512, 524) and begins(None, v_align=1024, r_align=64)[:2] == (1024, 1088)
    assert begins({"nc_var_align_size": "2048"}, v_align=1024)[0] == 2048
    monkeypatch.setenv(ds.HINTS_VARIABLE, "nc_var_align_size=4096;nc_record_align_size=8192")
    a, r, d = begins({"nc_var_align_size": "2048", "own": "x"}, v_align=1024)
    assert (a, r) == (4096, 8192) and d.inq_file_info()["nc_var_align_size"] == "4096" and d.inq_file_info()["own"] == "x" and d.inq_file_info()["nc_burst_buf"] == "disable"
    assert all(message(k) not in ("", str(k)) for k in Code) and message(-9999) == "unknown status -9999" and ds.inq_libvers()
    path = str(tmp_path / "bp")
    open(path, "wb").write(b"x" * 100 + struct.pack("<QQQI", 10, 30, 60, 3))
    assert cdf.sniff_path(path) == "BP" and code_of(Dataset.open, spark, path) == Code.NOTSUPPORT
    monkeypatch.setitem(ds.DRIVERS, "BP", lambda spark, path, write: (path, write))
    assert Dataset.open(spark, path) == (path, False)
    before = len(ds.inq_files_opened())
    with Dataset.create(spark, str(tmp_path / "b.nc")) as d:
        d.def_dim("x", 1)
        assert len(ds.inq_files_opened()) == before + 1 and ds.inq_files_opened()[-1].endswith("b.nc")
    assert len(ds.inq_files_opened()) == before


@pytest.mark.parametrize("shape", [(200_000,), (1, 300_000), (3, 7, 11), (40, 1, 900)])
def test_slabs_of_any_shape(spark, tmp_path, monkeypatch, shape):
    path = str(tmp_path / "s.nc")
    c = Catalog(5)
    for k, n in enumerate(shape):
        c.def_dim(f"d{k}", n)
    c.def_var("a", "int", [f"d{k}" for k in range(len(shape))])
    cdf.create(path, c)
    v = c.vars[0]
    with open(path, "r+b") as f:
        f.seek(v.begin)
        f.write(np.arange(np.prod(shape), dtype=">i4").tobytes())
    reader = cdf.CdfReader(path, "a", {})
    reader.SLAB = 1000
    parts = reader.partitions()
    assert len(parts) >= min(np.prod(shape) / 1000, 2 if np.prod(shape) > 1000 else 1)
    batches = [list(reader.read(p)) for p in parts]
    assert all(len(b) == 1 and b[0].num_rows <= 1000 for b in batches)
    got = np.zeros(shape, np.int32) - 1
    for (b,) in batches:
        got[tuple(b.column(f"i{k}").to_numpy() for k in range(len(shape)))] = b.column("v").to_numpy()
    assert (got.ravel() == np.arange(np.prod(shape))).all()
    low = [n // 3 for n in shape]
    box = cdf.CdfReader(path, "a", {"start": ",".join(map(str, low)), "count": ",".join(str(max(1, n // 2)) for n in shape)})
    cells = [x for p in box.partitions() for b in box.read(p) for x in b.column("v").to_pylist()]
    assert sorted(cells) == sorted(got[tuple(slice(a, a + max(1, n // 2)) for a, n in zip(low, shape, strict=True))].ravel().tolist())
    with open(path, "r+b") as f:  # cut off: the rest was never written
        f.truncate(v.begin + 40)
    assert sum(x for p in reader.partitions() for b in reader.read(p) for x in b.column("v").to_pylist()) == sum(range(10))


def test_runs(spark, tmp_path):
    """Runs of any length, over rows and records, are the cells they stand for."""
    path = str(tmp_path / "r.nc")
    c = Catalog(5)
    c.def_dim("t", 0)
    c.def_dim("y", 4)
    c.def_dim("x", 5)
    for name, kind in (("a", "short"), ("b", "double"), ("c", "char")):
        c.def_var(name, kind, ["t", "y", "x"])
    c.def_var("f", "uint64", ["y", "x"])
    c.numrecs = 3
    cdf.create(path, c)
    spark.dataSource.register(cdf.CdfSource)
    write = lambda df, var: df.write.format("cdf").mode("append").option("path", path).option("var", var).save()
    read = lambda var, **how: spark.read.format("cdf").options(path=path, var=var, **how).load()
    write(spark.createDataFrame([(0, 0, 0, [*range(20)]), (2, 1, 2, [7, 8, 9]), (2, 3, 0, [1]), (1, 0, 0, [])], "i0 long, i1 long, i2 long, v array<short>").repartition(2), "a")
    got = {(x.i0, x.i1, x.i2): x.v for x in read("a").collect()}
    fill = TYPES["short"].fill
    assert [got[0, j, k] for j in range(4) for k in range(5)] == list(range(20)) and [got[2, 1, k] for k in range(5)] == [fill, fill, 7, 8, 9] and got[2, 3, 0] == 1 and got[1, 0, 0] == fill
    rows = read("a", runs="true").collect()
    assert len(rows) == 12 and all(list(x.v) == [got[x.i0, x.i1, k] for k in range(5)] and x.i2 == 0 for x in rows)
    box = read("a", runs="true", start="2,1,2", count="1,1,3").collect()
    assert [(x.i0, x.i1, x.i2, list(x.v)) for x in box] == [(2, 1, 2, [7, 8, 9])]
    write(spark.createDataFrame([(0, 2, [Decimal(2**64 - 1), Decimal(5)])], "i0 long, i1 long, v array<decimal(20,0)>"), "f")
    assert [int(x.v) for x in read("f", start="0,2", count="1,2").orderBy("i1").collect()] == [2**64 - 1, 5]
    write(spark.createDataFrame([(1, 1, 0, [bytearray(b"h"), bytearray(b"i")])], "i0 long, i1 long, i2 long, v array<binary>"), "c")
    assert b"".join(bytes(x) for x in read("c", runs="true", start="1,1,0", count="1,1,3").first().v) == b"hi\0"


def interleaved(path, records, wide=3):
    c = Catalog(5)
    c.def_dim("t", 0)
    c.def_dim("x", wide)
    for name, kind, dims in (("a", "double", ["t"]), ("b", "int", ["t", "x"]), ("c", "byte", ["t"])):
        c.def_var(name, kind, dims)
    c.numrecs = records
    return cdf.create(path, c)


def arrow(rows, names, kinds):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def test_records_are_written_block_by_block(tmp_path, monkeypatch):
    """Cells of a record variable are no neighbours in the file; each was a write of its own."""
    import pyarrow as pa

    path, n, calls, pwrite = str(tmp_path / "a.nc"), 40_000, [], cdf.os.pwrite
    c = interleaved(path, n)
    monkeypatch.setattr(cdf.os, "pwrite", lambda *a: calls.append(1) or pwrite(*a))
    batches = [arrow([(k, float(k)) for k in range(lo, lo + 8000)], ["i0", "v"], [pa.int64(), pa.float64()]) for lo in range(0, n, 8000)]
    cdf.CdfSource({"path": path, "var": "a", "blocks": "true"}).writer(None, False).write(iter(batches))
    assert len(calls) <= n * c.recsize() // cdf.BLOCK + 2
    assert cdf.CdfReader(path, "a", {})._cells((0,), (n,)).tolist() == [float(k) for k in range(n)]
    assert (cdf.CdfReader(path, "b", {})._cells((0, 0), (n, 3)) == TYPES["int"].fill).all()
    assert (cdf.CdfReader(path, "c", {})._cells((0,), (n,)) == TYPES["byte"].fill).all()


@pytest.mark.parametrize(("held", "wide"), [(50, 3), (1 << 21, 3), (50, 2000), (7, 1)])
def test_blocks_leave_what_lies_between(tmp_path, monkeypatch, held, wide):
    """Shuffled cells with nulls, repeats and holes in several blocks; gaps below and (wide 2000) above those that are read."""
    import pyarrow as pa

    monkeypatch.setattr(cdf.CdfWriter, "HELD", held)
    monkeypatch.setattr(cdf, "BLOCK", 1 << 10)
    path, rng, n = str(tmp_path / "a.nc"), random.Random(held + wide), 300
    interleaved(path, n, wide)
    want = {"a": np.full(n, TYPES["double"].fill), "b": np.full((n, wide), TYPES["int"].fill), "c": np.full(n, TYPES["byte"].fill)}
    for name in "bacba":
        rank = want[name].ndim
        cells = [(rng.randrange(n), *([rng.randrange(wide)] if rank == 2 else []), rng.choice([None, rng.randrange(100)])) for _ in range(400)]
        cells.sort(key=lambda x: x[:-1]) if rng.random() < 0.7 else None
        for *at, v in cells:
            if v is not None:
                want[name][tuple(at)] = v
        kinds = [pa.int64()] * rank + [{"a": pa.float64(), "b": pa.int32(), "c": pa.int8()}[name]]
        cdf.CdfWriter(path, name, True).write(iter([arrow(cells[k : k + 30], [*["i0", "i1"][:rank], "v"], kinds) for k in range(0, 400, 30)]))
    for name, x in want.items():
        assert (cdf.CdfReader(path, name, {})._cells((0,) * x.ndim, x.shape) == x).all(), name


def test_first_put_joins_nothing_and_a_file_is_dealt_by_blocks(spark, tmp_path):
    path, n = str(tmp_path / "a.nc"), 70_000
    d = Dataset.create(spark, path, 5)
    d.def_dim("t")
    d.def_dim("x", 2)
    d.def_var("a", "double", ["t"])
    d.def_var("b", "int", ["t", "x"])
    d.enddef()
    apart = spark.range(n).repartition(7)  # records in no order
    d.put("a", apart.select(F.col("id").alias("i0"), (F.col("id") / 2).alias("v")))
    d.put("b", apart.select(F.col("id").alias("i0"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i1")).select("i0", F.col("i1").cast("long").alias("i1"), (F.col("i0") + F.col("i1")).cast("int").alias("v")))
    assert all("Join" not in d.cells[name]._jdf.queryExecution().optimizedPlan().toString() for name in "ab")
    tasks = cdf.dealt(d.cells["a"], d.catalog, d.catalog.var("a")).groupBy(F.floor(F.col("i0") * 16 / cdf.BLOCK), F.spark_partition_id().alias("p")).count()
    assert tasks.count() <= n * 16 // cdf.BLOCK + 2
    d.put("a", spark.createDataFrame([(5, -1.0), (n, -2.0)], "i0 long, v double"))  # a later put still meets the old cells
    d.close()
    e = Dataset.open(spark, path, write=True)
    assert e.get("a").agg(F.count("v"), F.sum("v")).first() == (n + 1, sum(k / 2 for k in range(n)) - 2.5 - 1 - 2)
    e.put("a", spark.createDataFrame([(7, -7.0)], "i0 long, v double"))
    e.close()
    f = Dataset.open(spark, path)
    assert f.get("a", [7], [1]).first().v == -7.0
    assert f.get("b").filter("v <> i0 + i1").filter(f"i0 < {n}").count() == 0 and f.get("b").count() == 2 * (n + 1)
