"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its elements, each named by its path from the root with classes and ids, and its blocks of text,
each by path and content.  Over the pages of a host a token has an occurrence vector: how often it occurs in each page.  Tokens
that share a vector form an equivalence class; a class is valid if at least half of the host's pages have it.  Valid classes
nest as the paths of their elements do: they are the host's template.  A text is fixed if it is in the class of an element
around it and that class has LEAST_SUPPORT pages or more (fewer pages may agree by chance); all else fills slots.  The
template's main element is the deepest that has MAIN_SHARE of the text in slots below it, on one page or a million.  A page
yields its slots below that element, without those whose element says that it is a menu, an advert, a comment and so on.
Names decide only what the template leaves open: a page's own article or main element within its main element, or where the
page lacks that.

Vectors are never built: a vector's fingerprint is a sum of hashes of (page, count), so tokens are counted by partial
aggregation and one host may have a third of all pages.  Copies of a page count once.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

# How HTML elements behave.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|object|svg|math|select"
DROPPED = frozenset("head nav header footer aside form menu dialog button script style textarea title noscript template iframe object svg math select label datalist audio video canvas".split())
# Words in a class, an id or a role that tell what an element is for.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login menu modal nav navbar navigation "
    "newsletter notice notices notification popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Different pages that a class needs before its text counts as fixed.
LEAST_SUPPORT = 8
#: Templates of at most so many hosts, and 16 times as many texts, are broadcast.
BROADCAST_HOSTS = 50_000
#: Pages of a host that are joined with its template as one part, about, where templates are not broadcast.
PAGES_A_PART = 5000
#: The main element holds at least this share of the text in slots.
MAIN_SHARE = 0.75
_LISTS = frozenset("ul ol dl li dt dd menu dir".split())
_HEADING = re.compile(r"h[1-6](\..*)?")

_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")


class _Element:
    __slots__ = ("name", "path", "dropped", "main")

    def __init__(self, name: str, attributes: str, parent: _Element | None):
        self.name = name
        label, words, hidden = "", (), False
        if attributes and not attributes.isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            named = " ".join(found[k] for k in ("class", "id", "role") if k in found).lower()
            words = _NAME.findall(named)
            label = "." + ".".join(words) if words else ""
            hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.path = f"{parent.path}/{name}{label}" if parent else name + label
        rooted = name in ("html", "body", "main")
        self.dropped = bool(parent and parent.dropped) or name in DROPPED or hidden or not rooted and not DROPPED_NAMES.isdisjoint(words)
        self.main = bool(parent and parent.main) or name in ("article", "main") or "main" in words and not self.dropped


class Page:
    """Elements (paths, in order) and blocks (path, dropped, in the main element, text) of a page."""

    def __init__(self, source: str):
        self.elements: list[str] = []
        self.blocks: list[tuple[str, bool, bool, str]] = []
        self._stack = [_Element("", "", None)]
        self.has_main = False
        self._text: list[str] = []
        self._holder = self._stack[0]
        at = 0
        for m in _MARKUP.finditer(source):
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            if m["raw"]:
                self._text.append(" ")
                continue
            name = (m["name"] or m["name2"] or "").lower()
            if name:
                (self._close if m["close"] or m["close2"] else self._open)(name, m["attributes"] or "")
        self._add(source[at:])
        self._flush()

    def _add(self, text: str) -> None:
        if not self._text or self._text[-1] == " ":
            self._holder = self._stack[-1] if self._stack[-1].dropped else self._block()
        if self._holder.dropped == self._stack[-1].dropped:
            self._text.append(text)
        elif self._stack[-1].dropped:
            return  # a dropped element inside a line
        else:
            self._flush()
            self._holder = self._block()
            self._text.append(text)

    def _block(self) -> _Element:
        return next((e for e in reversed(self._stack) if e.name in BLOCKS), self._stack[0])

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._text)).split())
        self._text = []
        if text:
            self.blocks.append((self._holder.path, self._holder.dropped, self._holder.main, text))

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        if name in BLOCKS:
            self._flush()
        if name in VOID:
            return
        for k in range(len(self._stack) - 1, 0, -1):  # elements that this one closes
            if name in _CLOSES.get(self._stack[k].name, ()):
                del self._stack[k:]
                break
            if self._stack[k].name in BLOCKS:
                break
        self._stack.append(_Element(name, attributes, self._stack[-1]))
        self.elements.append(self._stack[-1].path)
        self.has_main |= self._stack[-1].main
        if attributes.endswith("/") and name not in BLOCKS:
            self._stack.pop()

    def _close(self, name: str, _: str) -> None:
        if name in BLOCKS:
            self._flush()
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].name == name:
                del self._stack[k:]
                return
            if name not in BLOCKS and self._stack[k].name in BLOCKS:
                return  # an inline end tag does not close blocks


def _token(path: str, text: str = "") -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") >> 1 or 1


def _above(path: str) -> list[str]:
    """The paths of the elements around an element, from the root."""
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts))]


def _count(batches):
    """Tokens of the pages of a batch, summed by host; with the text that elements hold, themselves and below, unless it is dropped."""
    for batch in batches:
        sums: dict = defaultdict(lambda: [0, 0, None, 0, 0, 0])
        for host, source, key in zip(*(batch.column(k).to_pylist() for k in ("__gl_host", "__gl_html", "__gl_key")), strict=True):
            page = Page(source)
            of = {path: _token(path) for path in {"", *page.elements}}
            counts = Counter(map(of.__getitem__, ["", *page.elements]))
            for path, t in of.items():
                sums[host, t][2] = path
            for path, dropped, _, text in page.blocks:
                t = _token(path, text)
                counts[t] += 1
                s = sums[host, t]
                s[3] = of[path]
                if not dropped:
                    s[4] += len(text)
                    sums[host, of[path]][4] += len(text)
                    for above in _above(path):
                        sums[host, of[above]][5] += len(text)
            for t, n in counts.items():
                s = sums[host, t]
                s[0] += xxhash.xxh3_64_intdigest(f"{key} {n}") >> 28
                s[1] += 1
        columns = [[h for h, _ in sums], [t for _, t in sums], *([s[k] for s in sums.values()] for k in range(6))]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _COUNTED, strict=True)], schema=_COUNTED)


_COUNTED = c.arrow_schema(host=pa.string(), token=pa.int64(), vector=pa.int64(), pages=pa.int64(), path=pa.string(), holder=pa.int64(), chars=pa.int64(), below=pa.int64())


def _main(elements: pd.DataFrame, fixed: pd.DataFrame) -> str | None:
    """The deepest element with most of the text in slots below it; not a list, and with the headings beside it."""
    own, below = (dict(zip(elements["path"], map(int, elements[k]), strict=True)) for k in ("chars", "below"))
    paths = dict(zip(elements["token"], elements["path"], strict=True))
    for holder, chars in zip(fixed["holder"], fixed["chars"], strict=True):
        path = paths[int(holder)]
        own[path] -= int(chars)
        for above in _above(path):
            below[above] -= int(chars)
    children = defaultdict(list)
    for path in sorted(own):
        if path:
            children[path.rpartition("/")[0]].append(path)
    name = lambda path: path.rpartition("/")[2]
    at, total = "", own[""] + below[""]
    while total and not any(_HEADING.fullmatch(name(x)) and own[x] + below[x] for x in children[at]):
        inner = max((x for x in children[at] if name(x).partition(".")[0] not in _LISTS), key=below.__getitem__, default=None)
        if inner is None or below[inner] < MAIN_SHARE * total:
            break
        at = inner
    return at or None


def _nest(rows: pd.DataFrame) -> pd.DataFrame:
    """The template of one host, from its tokens with support in at least half of its pages."""
    pages = int(rows["host_pages"].iloc[0])
    elements, texts = rows[rows["path"].notna()], rows[rows["path"].isna()]
    vector = dict(zip(elements["path"], elements["vector"], strict=True))
    path = dict(zip(elements["token"], elements["path"], strict=True))
    # a text is of the template if an element around it has its vector: it stands wherever that element stands
    around = [path[int(h)] for h in texts["holder"]]
    in_class = [n >= LEAST_SUPPORT and any(vector[x] == v for x in (p, *_above(p))) for p, v, n in zip(around, texts["vector"], texts["pages"], strict=True)]
    fixed = texts[np.array(in_class, bool)]
    main = _main(elements, texts[texts["pages"] >= LEAST_SUPPORT])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "pages": [pages], "main": [main], "fixed": [sorted(map(int, fixed["token"]))], "template": [sorted(p for p in elements["path"] if p)]})


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The template of each host: host, pages, main (path of the main element, or null), fixed (tokens of text) and template (paths).

    A host's rows in one task are the tokens that half of its pages have: as many as a page has, however many pages.
    """
    # a host's copies are one page, or an article it repeats would look like its template
    source = pages.select(host_of(c.quoted(url_col)).alias("__gl_host"), c.quoted(html_col).alias("__gl_html")).filter("trim(__gl_html) <> ''").distinct().withColumn("__gl_key", F.xxhash64("__gl_html"))
    counted = source.mapInArrow(_count, "host string, token long, vector long, pages long, path string, holder long, chars long, below long")
    tokens = counted.groupBy("host", "token").agg(F.sum("vector").alias("vector"), F.sum("pages").alias("pages"), F.max("path").alias("path"), F.max("holder").alias("holder"), F.sum("chars").alias("chars"), F.sum("below").alias("below"))
    sizes = source.groupBy(F.col("__gl_host").alias("h")).agg(F.count(F.lit(1)).alias("host_pages"))
    common = tokens.join(sizes, tokens.host == sizes.h).filter("pages * 2 >= host_pages and (path is not null or pages > 1)").drop("h")
    return common.groupBy("host").applyInPandas(_nest, "host string, pages long, main string, fixed array<long>, template array<string>")


def slots(source: str, main: str | None = None, fixed: frozenset = frozenset()) -> list[str]:
    """The blocks of main text of a page, in order."""
    page = Page(source)
    # below the template's main element, there the page's own; without the first the second, a page without either is read whole
    inside = [b for b in page.blocks if main and (b[0] == main or b[0].startswith(main + "/"))]
    chosen = [b for b in inside if b[2]] or [b for b in page.blocks if b[2]] or inside
    if not chosen and not page.has_main:
        chosen = page.blocks
    kept = [(path, text) for path, dropped, _, text in chosen if not dropped]
    varying = [text for path, text in kept if not fixed or _token(path, text) not in fixed]
    return varying or [text for _, text in kept]  # a page of fixed text only is not emptied


def html_extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep_columns: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The main text of each page: keep_columns, url_col, ``text`` (blocks joined by a line end) and ``n_blocks``.

    Null, empty and very long pages each give a row, with text "" if there is none; pages without a host share the host "".
    Pages of a host with equal html count as one in its template, blank ones not at all; each row is returned.  A page whose main text is all fixed
    keeps it.  Kept columns may have any name but ``text`` and ``n_blocks``.  An empty table gives an empty result.
    """
    known = c.materialize(templates(pages, url_col, html_col).select(F.col("host").alias("__gl_h"), F.col("main").alias("__gl_main"), F.col("fixed").alias("__gl_fixed"), F.col("pages").alias("__gl_pages")))
    n_hosts, n_fixed, most = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__gl_fixed")), F.lit(0)), F.coalesce(F.max("__gl_pages"), F.lit(0))).first()
    source = pages.select(*[c.quoted(k).alias(k) for k in keep_columns], c.quoted(url_col).alias(url_col), c.quoted(html_col).alias("__gl_html"), host_of(c.quoted(url_col)).alias("__gl_host"))
    on = F.col("__gl_host") == F.col("__gl_h")
    if n_hosts + n_fixed // 16 <= BROADCAST_HOSTS:
        joined = source.join(F.broadcast(known), on, "left")
    else:  # the pages of a host are dealt out in as many parts as the largest host needs, hosts of one part once
        parts = F.ceil(F.col("__gl_pages") / PAGES_A_PART).cast("long")
        large = known.filter(parts > 1).select(F.col("__gl_h").alias("__gl_l"), parts.alias("__gl_n")) if most > PAGES_A_PART else known.limit(0).select(F.col("__gl_h").alias("__gl_l"), F.lit(1).cast("long").alias("__gl_n"))
        # fewer than all pages / PAGES_A_PART hosts are large
        source = source.join(F.broadcast(large) if n_hosts <= 10_000_000 else large, F.col("__gl_host") == F.col("__gl_l"), "left")
        source = source.withColumn("__gl_p", F.coalesce(F.pmod(F.xxhash64("__gl_html"), F.col("__gl_n")), F.lit(0)))
        spread = known.withColumn("__gl_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        joined = source.join(spread, on & (F.col("__gl_p") == F.col("__gl_part")), "left")
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [joined.schema[k] for k in (*keep_columns, url_col)]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType())])
    arrow = to_arrow_schema(schema)
    n_kept = len(kept)

    def extract(batches):
        for batch in batches:
            found = [slots(s or "", m, frozenset(f or ())) for s, m, f in zip(*(batch.column(k).to_pylist() for k in ("__gl_html", "__gl_main", "__gl_fixed")), strict=True)]
            columns = [batch.column(k) for k in range(n_kept)] + [pa.array(["\n".join(x) for x in found], pa.string()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return joined.select(*[c.quoted(k) for k in (*keep_columns, url_col)], "__gl_html", "__gl_main", "__gl_fixed").mapInArrow(extract, schema)


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    out = html_extract(c.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
