"""External types of array datasets, their limits and fill values, and the errors."""

from __future__ import annotations

import enum
import unicodedata
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import types as T


class Code(enum.IntEnum):
    """Status codes; fixed values of the classic format's libraries."""

    NOERR = 0
    BADID = -33
    EXIST = -35
    INVAL = -36
    PERM = -37
    NOTINDEFINE = -38
    INDEFINE = -39
    INVALCOORDS = -40
    NAMEINUSE = -42
    NOTATT = -43
    BADTYPE = -45
    BADDIM = -46
    UNLIMPOS = -47
    NOTVAR = -49
    GLOBAL = -50
    NOTNC = -51
    MAXNAME = -53
    UNLIMIT = -54
    CHAR = -56
    EDGE = -57
    STRIDE = -58
    BADNAME = -59
    RANGE = -60
    VARSIZE = -62
    DIMSIZE = -63
    LATEFILL = -122
    NULLPAD = -134
    NOTINDEP = -202
    INDEP = -203
    NEGATIVECNT = -210
    INVAL_REQUEST = -212
    NOTSUPPORT = -214
    NULLBUF = -215
    PREVATTACHBUF = -216
    NULLABUF = -217
    PENDINGBPUT = -218
    INSUFFBUF = -219
    NOENT = -220
    INVAL_CMODE = -228
    STRICTCDF2 = -232
    NOTRECVAR = -233
    NOTFILL = -234
    PENDING = -236
    FLUSHED = -239


class ArrayError(Exception):
    """An operation's failure, with its status code."""

    def __init__(self, code: Code, what: str = ""):
        super().__init__(f"{code.name} ({int(code)}){': ' + what if what else ''}")
        self.code = code


@dataclass(frozen=True)
class External:
    code: int
    name: str  # as CDL writes it
    size: int
    dtype: str  # big-endian, as files have it
    low: int | float | None
    high: int | float | None
    fill: int | float | bytes
    spark: T.DataType
    suffix: str  # of attribute constants in CDL


# Codes, sizes, limits and default fills of the external types.
_FLOAT_MAX, _DOUBLE_MAX, _FLOAT_FILL = 3.402823466e38, 1.7976931348623157e308, 9.9692099683868690e36
TYPES = {
    t.name: t
    for t in (
        External(1, "byte", 1, ">i1", -128, 127, -127, T.ByteType(), "b"),
        External(2, "char", 1, "S1", None, None, b"\0", T.BinaryType(), ""),
        External(3, "short", 2, ">i2", -(2**15), 2**15 - 1, -32767, T.ShortType(), "s"),
        External(4, "int", 4, ">i4", -(2**31), 2**31 - 1, -2147483647, T.IntegerType(), ""),
        External(5, "float", 4, ">f4", -_FLOAT_MAX, _FLOAT_MAX, float(np.float32(_FLOAT_FILL)), T.FloatType(), "f"),
        External(6, "double", 8, ">f8", -_DOUBLE_MAX, _DOUBLE_MAX, _FLOAT_FILL, T.DoubleType(), ""),
        External(7, "ubyte", 1, ">u1", 0, 255, 255, T.ShortType(), "ub"),
        External(8, "ushort", 2, ">u2", 0, 2**16 - 1, 65535, T.IntegerType(), "us"),
        External(9, "uint", 4, ">u4", 0, 2**32 - 1, 4294967295, T.LongType(), "u"),
        External(10, "int64", 8, ">i8", -(2**63), 2**63 - 1, -9223372036854775806, T.LongType(), "ll"),
        External(11, "uint64", 8, ">u8", 0, 2**64 - 1, 18446744073709551614, T.DecimalType(20, 0), "ull"),
    )
}
BY_CODE = {t.code: t for t in TYPES.values()}
CLASSIC = ("byte", "char", "short", "int", "float", "double")  # all that CDF-1 and CDF-2 have
FORMATS = {1: "classic", 2: "64-bit offset", 5: "64-bit data"}
UNLIMITED = 0
GLOBAL = -1


def external(name: str) -> External:
    if name not in TYPES:
        raise ArrayError(Code.BADTYPE, str(name))
    return TYPES[name]


def allowed(name: str, version: int) -> External:
    t = external(name)
    if version != 5 and name not in CLASSIC:
        raise ArrayError(Code.STRICTCDF2, f"{name} needs CDF-5")
    return t


def fill_literal(t: External):
    return bytearray(t.fill) if t.name == "char" else Decimal(t.fill) if t.name == "uint64" else t.fill


def checked_name(name: str) -> str:
    """The name in normal form C, if it is one."""
    name = unicodedata.normalize("NFC", name or "")
    if not name:
        raise ArrayError(Code.BADNAME, "empty")
    if len(name.encode()) > 256:
        raise ArrayError(Code.MAXNAME, name[:40])
    first = name[0]
    if not (first.isascii() and first.isalnum() or first == "_" or not first.isascii()) or "/" in name or name.endswith(" ") or any(ord(x) < 32 or ord(x) == 127 for x in name):
        raise ArrayError(Code.BADNAME, repr(name))
    return name


#: What each status says to a user.
TEXTS = {
    Code.NOERR: "no error", Code.BADID: "not a dataset's number", Code.EXIST: "the file exists and was not to be overwritten", Code.INVAL: "an invalid argument",
    Code.PERM: "writing to a dataset opened for reading", Code.NOTINDEFINE: "allowed in define mode only", Code.INDEFINE: "not allowed in define mode",
    Code.INVALCOORDS: "an index is beyond its dimension", Code.NAMEINUSE: "the name is in use", Code.NOTATT: "no such attribute", Code.BADTYPE: "not a data type",
    Code.BADDIM: "no such dimension", Code.UNLIMPOS: "the unlimited dimension has to be the first", Code.NOTVAR: "no such variable", Code.GLOBAL: "not allowed for the global variable",
    Code.NOTNC: "not a file of a known format", Code.MAXNAME: "the name is too long", Code.UNLIMIT: "there is an unlimited dimension already", Code.CHAR: "text and numbers do not convert",
    Code.EDGE: "start and count reach beyond a dimension", Code.STRIDE: "a stride is not positive", Code.BADNAME: "the name has characters that are not allowed",
    Code.RANGE: "a value is out of the type's range", Code.VARSIZE: "a variable is too large for the format", Code.DIMSIZE: "a dimension is too long for the format",
    Code.LATEFILL: "a fill value has to be set before data is written", Code.NULLPAD: "the header's padding is not null", Code.NOTINDEP: "allowed in independent mode only",
    Code.INDEP: "not allowed in independent mode", Code.NEGATIVECNT: "a count is negative", Code.INVAL_REQUEST: "no such request", Code.NOTSUPPORT: "not supported",
    Code.NULLBUF: "a buffer needs a positive size", Code.PREVATTACHBUF: "a buffer is attached already", Code.NULLABUF: "no buffer is attached", Code.PENDINGBPUT: "the buffer holds pending writes",
    Code.INSUFFBUF: "the buffer is too small", Code.NOENT: "no such file", Code.INVAL_CMODE: "an invalid mode of creation", Code.STRICTCDF2: "the format lacks this type",
    Code.NOTRECVAR: "not a record variable", Code.NOTFILL: "the variable is not filled", Code.PENDING: "requests were still pending", Code.FLUSHED: "the request has been flushed",
}


def message(code: int) -> str:
    """The text of a status, and for other numbers that there is none."""
    try:
        return TEXTS[Code(code)]
    except ValueError:
        return f"unknown status {code}"


def status_name(code: int) -> str:
    try:
        return Code(code).name
    except ValueError:
        return f"unknown status {code}"
