"""The catalogue of a dataset (dimensions, variables, attributes) and the layout of its file."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field, replace

from ..functions.types import GLOBAL, UNLIMITED, ArrayError, Code, allowed, checked_name, external

LIMITS = {1: 2**31 - 4, 2: 2**32 - 4, 5: 2**63 - 4}


@dataclass
class Dim:
    name: str
    size: int  # UNLIMITED: the record dimension


@dataclass
class Att:
    name: str
    xtype: str
    values: list | str  # text for char


@dataclass
class Var:
    name: str
    xtype: str
    dims: list[int]
    atts: list[Att] = field(default_factory=list)
    no_fill: bool = True
    begin: int = 0

    def att(self, name: str) -> Att | None:
        return next((a for a in self.atts if a.name == name), None)


@dataclass
class Catalog:
    version: int = 1
    dims: list[Dim] = field(default_factory=list)
    vars: list[Var] = field(default_factory=list)
    atts: list[Att] = field(default_factory=list)
    numrecs: int = 0
    _places: dict[str, dict[str, int]] = field(default_factory=dict, repr=False, compare=False)

    def place(self, kind: str, name: str) -> int | None:
        """Where a name is among ``dims`` or ``vars``, by a table that new items join; ``renamed`` makes it anew."""
        name, items = unicodedata.normalize("NFC", name), getattr(self, kind)
        table = self._places.setdefault(kind, {})
        for k in range(len(table), len(items)):
            table[items[k].name] = k
        return table.get(name)

    def renamed(self) -> None:
        """To be told when a dimension or variable has another name."""
        self._places.clear()

    def dim(self, name: str) -> int:
        return _found(self.place("dims", name), name, Code.BADDIM)

    def var(self, name: str | int) -> Var:
        if isinstance(name, int):
            if not 0 <= name < len(self.vars):
                raise ArrayError(Code.GLOBAL if name == GLOBAL else Code.NOTVAR, str(name))
            return self.vars[name]
        return self.vars[_found(self.place("vars", name), name, Code.NOTVAR)]

    def holder(self, var: str | int | None) -> list[Att]:
        return self.atts if var in (None, GLOBAL) else self.var(var).atts

    def is_record(self, v: Var) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]].size == UNLIMITED

    def shape(self, v: Var) -> list[int]:
        return [self.numrecs if self.dims[d].size == UNLIMITED else self.dims[d].size for d in v.dims]

    def inner(self, v: Var) -> int:
        """Elements of a fixed variable, or of one record."""
        out = 1
        for d in v.dims[1 if self.is_record(v) else 0 :]:
            out *= self.dims[d].size
        return out

    def vsize(self, v: Var) -> int:
        """Bytes of a fixed variable, or of one record, rounded up to 4."""
        return -(-self.inner(v) * external(v.xtype).size // 4) * 4

    def recsize(self) -> int:
        own = [v for v in self.vars if self.is_record(v)]
        if len(own) == 1:  # a single record variable is not padded
            return self.inner(own[0]) * external(own[0].xtype).size
        return sum(self.vsize(v) for v in own)

    def def_dim(self, name: str, size: int) -> int:
        name = checked_name(name)
        if size < 0 or self.version != 5 and size > 2**31 - 1:
            raise ArrayError(Code.DIMSIZE, name)
        if size == UNLIMITED and any(d.size == UNLIMITED for d in self.dims):
            raise ArrayError(Code.UNLIMIT, name)
        if self.place("dims", name) is not None:
            raise ArrayError(Code.NAMEINUSE, name)
        self.dims.append(Dim(name, size))
        return len(self.dims) - 1

    def def_var(self, name: str, xtype: str, dims: list[int | str], no_fill: bool = True) -> int:
        name = checked_name(name)
        allowed(xtype, self.version)
        ids = [self.dim(d) if isinstance(d, str) else d for d in dims]
        if any(not 0 <= d < len(self.dims) for d in ids):
            raise ArrayError(Code.BADDIM, name)
        if any(self.dims[d].size == UNLIMITED for d in ids[1:]):
            raise ArrayError(Code.UNLIMPOS, name)
        if self.place("vars", name) is not None:
            raise ArrayError(Code.NAMEINUSE, name)
        self.vars.append(Var(name, xtype, ids, no_fill=no_fill))
        return len(self.vars) - 1

    def header_length(self) -> int:
        from ..sources.cdf import encode_header

        return len(encode_header(self))

    def lay_out(self, h_minfree: int = 0, v_align: int = 512, v_minfree: int = 0, r_align: int = 4) -> Catalog:
        """Begins of all variables: header, fixed variables in order of definition, then the record section."""
        self.check_sizes()
        up = lambda x, a: -(-x // a) * a
        fixed = [v for v in self.vars if not self.is_record(v)]
        at = up(self.header_length() + h_minfree, max(4, v_align if fixed else 4))
        for v in fixed:
            v.begin = at
            at = up(at + self.vsize(v), 4)
        at = up(at + v_minfree, max(4, r_align))
        for v in self.vars:
            if self.is_record(v):
                v.begin = at
                at += self.vsize(v)
        return self

    def check_sizes(self) -> None:
        most = LIMITS[self.version]
        for own in ([v for v in self.vars if not self.is_record(v)], [v for v in self.vars if self.is_record(v)]):
            large = [k for k, v in enumerate(own) if self.vsize(v) > most]
            if large and (self.version == 5 or large != [len(own) - 1] or own and self.is_record(own[0]) is False and any(self.is_record(v) for v in self.vars)):
                raise ArrayError(Code.VARSIZE, own[large[0]].name)

    def check_layout(self) -> None:
        """Begins ascend in order of definition and ranges do not overlap."""
        end = self.header_length()
        for record in (False, True):
            for v in self.vars:
                if self.is_record(v) == record:
                    if v.begin < end:
                        raise ArrayError(Code.NOTNC, f"{v.name} begins at {v.begin}, before {end}")
                    end = v.begin + self.vsize(v)

    def copy(self) -> Catalog:
        return Catalog(self.version, [replace(d) for d in self.dims], [replace(v, dims=list(v.dims), atts=[replace(a) for a in v.atts]) for v in self.vars], [replace(a) for a in self.atts], self.numrecs)


def _found(k: int | None, name: str, code: Code) -> int:
    if k is None:
        raise ArrayError(code, name)
    return k
