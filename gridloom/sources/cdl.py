"""CDL, the text form of a dataset: parser and dump."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import FORMATS, TYPES, UNLIMITED, ArrayError, Code, External, external
from ..operators.update import coords
from ..plans.catalog import Att, Catalog, Var

_TOKEN = re.compile(r"\s+|//[^\n]*|(?P<string>\"(?:[^\"\\]|\\.)*\")|(?P<char>'(?:[^'\\]|\\.[0-7]{0,2})')|(?P<mark>[{}=;:,()])|(?P<word>(?:[^\s{}=;:,()\"'\\]|\\.)+)", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "0": "\0"}
_ALIASES = {"long": "int", "real": "float", "unsigned": "ubyte"}
# What a constant's suffix says of its type.
_SUFFIXES = (("ull", "uint64"), ("ll", "int64"), ("ub", "ubyte"), ("us", "ushort"), ("u", "uint"), ("b", "byte"), ("s", "short"), ("f", "float"), ("d", "double"), ("l", "int"))
_NUMBER = re.compile(r"([+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))([a-zA-Z]*)$")
FILL = object()


def _plain(text: str) -> str:
    return re.sub(r"\\([0-7]{1,3}|.)", lambda m: chr(int(m[1], 8)) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), text, flags=re.DOTALL)


def constant(word: str):
    """(type, value) of a constant; ``_`` is the fill, and the names of specials stand for the default fill."""
    if word == "_":
        return None, FILL
    bare = word.lstrip("+-").lower()
    if bare in ("nan", "infinity", "inf", "doubleinf", "floatinf", "nanf", "inff", "infinityf"):
        kind = "float" if bare.endswith("f") and bare not in ("inf",) and "double" not in bare or bare.startswith("float") else "double"
        return kind, (-1 if word.startswith("-") else 1) * TYPES[kind].fill
    m = _NUMBER.match(word)
    if not m:
        raise ArrayError(Code.INVAL, f"constant {word}")
    digits, suffix = m[1], m[2].lower()
    if digits.lower().lstrip("+-").startswith("0x"):
        return "int", int(digits, 16)
    kind = next((t for s, t in _SUFFIXES if s == suffix), None)
    if suffix and kind is None:
        raise ArrayError(Code.INVAL, f"constant {word}")
    if kind is None:
        if re.fullmatch(r"[+-]?\d+", digits):
            octal = re.fullmatch(r"[+-]?0[0-7]+", digits)
            value = int(digits, 8 if octal else 10)
            return ("int", value) if -(2**31) <= value < 2**31 else ("double", float(value))
        return "double", float(digits)
    return kind, float(digits) if kind in ("float", "double") else int(float(digits))


class _Tokens:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ArrayError(Code.INVAL, f"at {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup:
                self.items.append((m.lastgroup, m[m.lastgroup]))
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.items[k][1] if k < len(self.items) else ""

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.items):
            raise ArrayError(Code.INVAL, "the text ends early")
        self.at += 1
        return self.items[self.at - 1]

    def want(self, mark: str) -> None:
        got = self.next()[1]
        if got != mark:
            raise ArrayError(Code.INVAL, f"{got!r}, not {mark!r}")

    def section(self, name: str) -> bool:
        if self.peek() == name and self.peek(1) == ":":
            self.at += 2
            return True
        return False


def parse(text: str, version: int = 1, header_only: bool = False) -> tuple[Catalog, dict[str, list]]:
    """The catalogue and each variable's values in order (None: not given, so filled; records grow with the data)."""
    t = _Tokens(text)
    if t.next()[1] != "netcdf":
        raise ArrayError(Code.INVAL, "no CDL")
    while t.peek() != "{":
        t.next()
    t.want("{")
    c, data = Catalog(version), {}
    if t.section("dimensions"):
        while t.peek(1) == "=" or t.peek() in (",", ";"):
            if t.peek() in (",", ";"):
                t.next()
                continue
            name = _plain(t.next()[1])
            t.want("=")
            size = t.next()[1]
            if size.lower() != "unlimited" and (not size.isdigit() or int(size) < 1):
                raise ArrayError(Code.DIMSIZE, f"{name} = {size}")
            c.def_dim(name, UNLIMITED if size.lower() == "unlimited" else int(size))
    if t.section("variables"):
        _declarations(t, c)
    elif t.peek() == ":":
        _declarations(t, c)
    if not header_only and t.section("data"):
        while t.peek() not in ("}", ""):
            v = c.var(_plain(t.next()[1]))
            t.want("=")
            data[v.name] = _values(t, v, c)
    if not header_only:
        t.want("}")
    return c, data


def _declarations(t: _Tokens, c: Catalog) -> None:
    while t.peek() not in ("}", "") and not (t.peek() == "data" and t.peek(1) == ":"):
        if t.peek() == ":" or t.peek(1) == ":":
            holder = None if t.peek() == ":" else _plain(t.next()[1])
            t.want(":")
            _attribute(t, c, holder)
            continue
        kind = t.next()[1].lower()
        kind = _ALIASES.get(kind, kind)
        if t.peek(1) == ":":  # a typed attribute
            holder = _plain(t.next()[1])
            t.want(":")
            _attribute(t, c, holder, kind)
            continue
        external(kind)
        while True:
            name, dims = _plain(t.next()[1]), []
            if t.peek() == "(":
                t.next()
                while t.peek() != ")":
                    if t.peek() == ",":
                        t.next()
                    dims.append(_plain(t.next()[1]))
                t.next()
            c.def_var(name, kind, dims)
            if t.next()[1] == ";":
                break


def _attribute(t: _Tokens, c: Catalog, holder: str | None, kind: str | None = None) -> None:
    name = _plain(t.next()[1])
    t.want("=")
    kinds, values, texts = set(), [], []
    while True:
        group, word = t.next()
        if group == "string":
            texts.append(_plain(word[1:-1]))
        elif group == "char":
            texts.append(_plain(word[1:-1]))
        else:
            k, x = constant(word)
            kinds.add(k)
            values.append(x)
        mark = t.next()[1]
        if mark == ";":
            break
    if texts and values or len(kinds) > 1:
        raise ArrayError(Code.BADTYPE, f"{name}: values of several types")
    atts = c.holder(holder)
    if any(a.name == name for a in atts):
        raise ArrayError(Code.NAMEINUSE, name)
    atts.append(Att(name, "char", "".join(texts)) if texts else Att(name, kind or kinds.pop(), values))
    if holder and name == "_FillValue":
        c.var(holder).no_fill = False


def _values(t: _Tokens, v: Var, c: Catalog) -> list:
    out: list = []
    width = c.shape(v)[-1] if v.dims and not (len(v.dims) == 1 and c.is_record(v)) else 1
    kind = external(v.xtype)
    while True:
        group, word = t.next()
        if group in ("string", "char") and v.xtype == "char":
            raw = _plain(word[1:-1]).encode()
            out += [bytes([x]) for x in raw]
            if group == "string":
                out += [b"\0"] * (-len(raw) % width if len(raw) else width)
        elif group in ("string", "char"):
            raise ArrayError(Code.CHAR, v.name)
        else:
            k, x = constant(word)
            out.append(None if x is FILL else _assign(x, kind))
        if t.next()[1] == ";":
            break
    inner = c.inner(v)
    if c.is_record(v):
        records = -(-len(out) // max(1, inner))
        c.numrecs = max(c.numrecs, records)
        out += [None] * (records * inner - len(out))
    elif len(out) > inner:
        raise ArrayError(Code.EDGE, f"{v.name}: {len(out)} values for {inner}")
    else:
        out += [None] * (inner - len(out))
    return out


def _assign(x, t: External):
    """As C assigns: no range check."""
    if t.name == "char":
        return bytes([int(x) & 255])
    if t.name in ("float", "double"):
        return float(np.float32(x)) if t.name == "float" else float(x)
    bits = 8 * t.size
    n = int(x) & ((1 << bits) - 1)
    return n - (1 << bits) if t.low < 0 and n >= 1 << (bits - 1) else n


def frames(spark: SparkSession, c: Catalog, data: dict[str, list]) -> dict[str, DataFrame]:
    """Each variable's cells, filled where no value was given."""
    from .cdf import schema_of

    out = {}
    for v in c.vars:
        shape = c.shape(v)
        n = int(np.prod(shape, dtype=np.int64)) if shape else 1
        values = data.get(v.name, [])
        values = values + [None] * (n - len(values))
        own = v.att("_FillValue")
        t = external(v.xtype)
        fill = (own.values.encode()[:1] if isinstance(own.values, str) else own.values[0]) if own else t.fill
        from decimal import Decimal

        cast = {"uint64": Decimal, "char": bytearray}.get(v.xtype, lambda x: x)
        index = np.array(np.unravel_index(np.arange(n), shape)).T.tolist() if shape else [[]]
        out[v.name] = spark.createDataFrame([(*map(int, i), cast(fill if x is None else x)) for i, x in zip(index, values, strict=True)], schema_of(c, v))
    return out


# --- dump ---------------------------------------------------------------------------------------


def _name(s: str) -> str:
    return re.sub(r"([^\w.@+\-]|^\d)", lambda m: "\\" + m[1] if m[1].isascii() else m[1], s)


def quoted(text: str) -> str:
    codes = {"\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f", "\v": "\\v", '"': '\\"', "\\": "\\\\", "'": "\\'"}
    return '"' + "".join(codes.get(x) or (f"\\{ord(x):03o}" if ord(x) < 32 or ord(x) == 127 else x) for x in text.rstrip("\0")) + '"'


def number(x, xtype: str, how: str | None = None) -> str:
    """C's conversions: %.7g for floats, %.15g for doubles, unless ``how`` says otherwise."""
    if xtype in ("float", "double"):
        return (how or ("%.7g" if xtype == "float" else "%.15g")) % x
    return how % int(x) if how else str(int(x))


def dump_header(c: Catalog, name: str = "dataset") -> str:
    out = [f"netcdf {name} {{", f"// file format: CDF-{c.version} ({FORMATS[c.version]})"]
    if c.dims:
        out.append("dimensions:")
        out += [f"\t{_name(d.name)} = {f'UNLIMITED ; // ({c.numrecs} currently)' if d.size == UNLIMITED else f'{d.size} ;'}" for d in c.dims]

    def attribute(owner: str, a: Att) -> str:
        if a.xtype == "char":
            shown = quoted(a.values)
        else:
            shown = ", ".join(_constant(x, a.xtype) for x in a.values)
        return f"\t\t{owner}:{_name(a.name)} = {shown} ;"

    if c.vars:
        out.append("variables:")
        for v in c.vars:
            out.append(f"\t{v.xtype} {_name(v.name)}" + (f"({', '.join(_name(c.dims[d].name) for d in v.dims)})" if v.dims else "") + " ;")
            out += [attribute(_name(v.name), a) for a in v.atts]
    if c.atts:
        out += ["", "// global attributes:", *[attribute("", a) for a in c.atts]]
    return "\n".join(out) + "\n"


def _constant(x, xtype: str) -> str:
    shown = number(x, xtype)
    if xtype in ("float", "double") and re.fullmatch(r"[+-]?\d+", shown):
        shown += "."
    return shown + TYPES[xtype].suffix


def shown(df: DataFrame, xtype: str, how: str | None = None, fill=None) -> Column:
    """A cell's value as a dump prints it: fill as _, whole numbers by the JVM, reals (and any ``how``) by C's rules over Arrow."""
    from ..functions.convert import is_fill

    if xtype in ("float", "double") or how:

        @F.pandas_udf("string")  # C's %g, which the JVM's formatter does not have
        def text(v: pd.Series) -> pd.Series:
            return v.map(lambda x: number(x, xtype, how), na_action="ignore").astype(object)

        plain = text(F.col("v").cast("double" if xtype in ("float", "double") else "string") if xtype != "float" else F.col("v"))
    else:
        plain = F.col("v").cast("string")
    return F.when(is_fill(F.col("v"), xtype, fill), "_").otherwise(plain)


def rows(df: DataFrame, xtype: str, how: str | None = None, fill=None) -> DataFrame:
    """The last dimension's rows as text: leading coordinates and ``line``, formatted on the executors."""
    on = coords(df)
    cell = F.struct(F.col(on[-1]).alias("k") if on else F.lit(0).alias("k"), (F.col("v") if xtype == "char" else shown(df, xtype, how, fill)).alias("v"))
    grouped = df.select(*on[:-1], cell.alias("cell")).groupBy(*on[:-1]).agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    if xtype != "char":
        return grouped.select(*on[:-1], F.array_join(F.transform("cells", lambda x: x["v"]), ", ").alias("line"))

    @F.pandas_udf("string")
    def line(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: quoted(bytes(x).decode("utf-8", "replace")))

    joined = F.unhex(F.array_join(F.transform("cells", lambda x: F.hex(x["v"])), ""))
    return grouped.select(*on[:-1], line(joined).alias("line"))


def text(run: Column) -> Column:
    """A run of characters (an array) as a string without the NULs at its end."""
    return F.rtrim(F.array_join(run, ""), F.lit("\0"))


def annotated(df: DataFrame, style: str = "c") -> DataFrame:
    """Cells with ``index``, as a dump's comments name them: from 0 in C, reversed and from 1 in Fortran."""
    on = coords(df)
    if style == "c":
        index = F.concat(F.lit("["), F.concat_ws(",", *[F.col(k).cast("string") for k in on]), F.lit("]"))
    else:
        index = F.concat(F.lit("("), F.concat_ws(",", *[(F.col(k) + 1).cast("string") for k in reversed(on)]), F.lit(")"))
    return df.withColumn("index", index)


def dump(
    c: Catalog, variables: dict[str, DataFrame], name: str = "dataset", only: Sequence[str] | None = None, coordinates: bool = False, header: bool = False,
    width: int = 80, brief: str | None = None, full: str | None = None, precision: tuple[int, int] | None = None,
) -> str:
    """The dataset as CDL.  ``only``: variables with data; ``coordinates``: just those named like a dimension; ``header``: none.

    ``precision``: digits of floats and doubles, before a C_format attribute and the type's default.  ``brief`` ("c" or "fortran")
    puts the indices of a row into a comment before it, ``full`` those of each cell behind it.  For datasets that one reads:
    the text is made on the driver; ``rows`` and ``annotated`` are the distributed parts.
    """
    out = [dump_header(c, name)]
    if not header:
        dims = {d.name for d in c.dims}
        chosen = [v for v in c.vars if (only is None or v.name in only) and (not coordinates or len(v.dims) == 1 and v.name in dims)]
        if chosen:
            out.append("data:\n")
        for v in chosen:
            own, c_format = v.att("_FillValue"), v.att("C_format")
            how = f"%.{precision[v.xtype == 'double']}g" if precision and v.xtype in ("float", "double") else c_format.values if c_format else None
            fill = own.values[0] if own and v.xtype != "char" else None
            df = variables[v.name]
            if full and v.xtype != "char" and v.dims:
                cells = annotated(df.withColumn("text", shown(df, v.xtype, how, fill)), full).orderBy(*coords(df)).select("text", "index").collect()
                if cells:
                    lines = [f"    {x.text}{';' if k == len(cells) - 1 else ','}  // {_name(v.name)}{x.index}" for k, x in enumerate(cells)]
                    out.append(f"\n {_name(v.name)} =\n" + "\n".join(lines) + "\n")
                continue
            found = rows(df, v.xtype, how, fill)
            on = [x for x in found.columns if x != "line"]
            found = (found.orderBy(*on) if on else found).collect()
            found = [r for r in found if r.line]  # a record variable without records has no data
            lines = [r.line for r in found]
            if lines:
                one = f" {_name(v.name)} = " + lines[0] + " ;\n"
                if brief and on:
                    span = f"0-{c.shape(v)[-1] - 1}" if brief == "c" else f"1-{c.shape(v)[-1]}"
                    at = lambda r: ",".join([*[str(r[k]) for k in on], span] if brief == "c" else [span, *[str(r[k] + 1) for k in reversed(on)]])
                    marks = ["  // " + _name(v.name) + ("[{}]" if brief == "c" else "({})").format(at(r)) + "\n" for r in found]
                else:
                    marks = [""] * len(lines)
                short = len(lines) == 1 and len(one) <= width and not marks[0]
                out.append("\n" + (one if short else f" {_name(v.name)} =\n" + ",\n".join(m + _wrapped("  " + x, width) for m, x in zip(marks, lines, strict=True)) + " ;\n"))
    return "".join(out) + "}\n"


def _wrapped(line: str, width: int) -> str:
    out, row = [], ""
    for word in line.split(", ") if not line.lstrip().startswith('"') else [line]:
        if row and len(row) + len(word) + 3 > width:
            out.append(row + ",")
            row = "    " + word
        else:
            row = f"{row}, {word}" if row else word
    return "\n".join([*out, row])
