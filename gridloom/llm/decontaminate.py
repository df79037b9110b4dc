"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask such as ``1101001`` hashes the words at its ones and ignores those at its zeros, so a hit survives substituted
words.  Every position of every document is hashed under every mask and joined to the hashes of the benchmark; around a
hit the aligned stretch is compared word by word, and the document counts as contaminated if enough words agree.

The benchmark is two tables: hashes with item and position, and the words of each item once.  Both are counted, and
broadcast while they are small: the exploded positions never leave their stage then, the words stay beside them.  Else
hash, document and position are shuffled, and only the hits meet the words of documents and items.  Only verified overlaps
are aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: Fixed masks; each has four sampled positions.
MASKS = ("11011", "1010011", "110000101")
#: A benchmark is broadcast if it has at most so many hashes and so many bytes of words.
BROADCAST_SEEDS, BROADCAST_BYTES = 1_000_000, 16 << 20
_PUNCTUATION = ".,;:!?\"()[]"


def _words(text: Column) -> Column:
    """Words without case and punctuation; ß is ss, as its upper case is, and the final sigma a sigma."""
    return c.words_of(F.replace(F.translate(F.lower(text), "ς" + _PUNCTUATION, "σ"), F.lit("ß"), F.lit("ss")))


def _seed(words: Column, at: Column, mask: str) -> Column:
    picked = [F.get(words, at + F.lit(k)) for k, bit in enumerate(mask) if bit == "1"]
    return F.xxhash64(F.lit(mask), *picked)


def _seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """One row for each position and mask that fits; needs __gl_words, adds __gl_at and __gl_seed.  Texts too short for any mask: one row, for the whole."""
    n, shortest = len(masks), min(map(len, masks))
    i, size = F.col("__gl_i"), F.size("__gl_words")
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.when(size < shortest, 0).otherwise(n * size - 1))).alias("__gl_i")).withColumn("__gl_at", F.floor(i / n).cast("int"))
    which = i % n
    seed = reduce(lambda rest, k: F.when(which == k, _seed(F.col("__gl_words"), F.col("__gl_at"), masks[k])).otherwise(rest), range(n - 1), _seed(F.col("__gl_words"), F.col("__gl_at"), masks[-1]))
    span = reduce(lambda rest, k: F.when(which == k, len(masks[k])).otherwise(rest), range(n - 1), F.lit(len(masks[-1])))
    whole = F.xxhash64(F.lit("whole"), F.col("__gl_words"))
    return rows.withColumn("__gl_seed", F.when(size < shortest, whole).otherwise(seed)).filter((F.col("__gl_at") + span <= size) | (size < shortest))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, min_percent: int = 80, region: int = 50, min_words: int = 8) -> DataFrame:
    """The pairs of document and benchmark item that overlap.

    Around a hit, the region is the whole item, or ``region`` words of a longer item centred on the hit; the pair counts
    if at least ``min_percent`` of 100 of its words stand at the same places in the document, all of them if the item has
    fewer than ``min_words`` words.  An item shorter than every mask counts only where it is the whole document.  Words are
    compared without punctuation and case, in any script.  Returns ``id_col``, ``item_col``, ``n_match`` and ``n_region`` (ints;
    of the best region: the most matches, then the shortest region), one row a pair.

    Null, empty and wordless texts overlap with nothing, rows with a null id or item are left out, repeated rows count
    once, rows that share an id count by their best, and empty tables give an empty result.  Texts and items of any length
    are read whole.  Other columns are not touched and may have any name.
    """
    shortest = min(map(len, masks))
    items = benchmark.select(c.quoted(item_col).alias("__gl_item"), _words(c.quoted(item_text_col)).alias("__gl_words")).filter(F.col("__gl_item").isNotNull() & (F.size("__gl_words") >= 1))
    items = items.withColumn("__gl_key", F.xxhash64("__gl_item", "__gl_words"))
    told = c.materialize(items.dropDuplicates(["__gl_key"]).select("__gl_key", "__gl_item", F.col("__gl_words").alias("__gl_item_words")))
    seeds = _seeds(told.select(F.col("__gl_key").alias("__gl_seed_key"), F.col("__gl_item_words").alias("__gl_words")), masks).select("__gl_seed", "__gl_seed_key", F.col("__gl_at").alias("__gl_item_at"))
    seeds = c.materialize(seeds)
    n_bytes = told.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "__gl_item_words"))), F.lit(0))).first()[0]
    docs = docs.select(c.quoted(id_col).alias("__gl_id"), _words(c.quoted(text_col)).alias("__gl_words")).filter(F.col("__gl_id").isNotNull() & (F.size("__gl_words") >= 1))
    if seeds.count() <= BROADCAST_SEEDS and n_bytes <= BROADCAST_BYTES:
        hits = _seeds(docs, masks).join(F.broadcast(seeds), "__gl_seed").join(F.broadcast(told), F.col("__gl_seed_key") == F.col("__gl_key"))
    else:
        docs = docs.withColumn("__gl_text_key", F.xxhash64("__gl_words"))  # rows that share an id stay apart
        at = _seeds(docs, masks).select("__gl_seed", "__gl_id", "__gl_text_key", "__gl_at").join(seeds, "__gl_seed").drop("__gl_seed").distinct()
        hits = at.join(docs.dropDuplicates(["__gl_id", "__gl_text_key"]), ["__gl_id", "__gl_text_key"]).join(told, F.col("__gl_seed_key") == F.col("__gl_key"))
    total, at = F.size("__gl_item_words"), F.col("__gl_item_at")
    length = F.least(total, F.lit(region))
    start = F.greatest(F.lit(0), F.least(at - F.floor(length / 2).cast("int"), total - length))
    first = F.col("__gl_at") - at + start  # where the region begins in the document; may lie before it
    need = F.when((total < shortest) & (F.size("__gl_words") != total), 101).when(total < min_words, 100).otherwise(min_percent)
    # A hit leaves generated code with the two stretches only, not with all words of its document.
    stretch = F.slice("__gl_words", F.greatest(first, F.lit(0)) + 1, F.greatest(length + F.least(first, F.lit(0)), F.lit(0)))
    hits = hits.select("__gl_id", "__gl_item", stretch.alias("__gl_own"), F.slice("__gl_item_words", start + 1, length).alias("__gl_its"), F.greatest(-first, F.lit(0)).alias("__gl_lead"), need.alias("need"))
    same = F.size(F.filter(F.sequence(F.lit(0), F.size("__gl_its") - 1), lambda k: F.get("__gl_own", F.when(k >= F.col("__gl_lead"), k - F.col("__gl_lead"))) == F.get("__gl_its", k)))
    # Exploded, so that the comparison is not pushed into the join.
    region_of = F.explode(F.array(F.struct(same.alias("n_match"), F.size("__gl_its").alias("n_region"), F.col("need").alias("need")))).alias("__gl_region")
    found = hits.select("__gl_id", "__gl_item", region_of).select("__gl_id", "__gl_item", "__gl_region.*").filter(F.col("n_match") * 100 >= F.col("n_region") * F.col("need"))
    best = found.groupBy("__gl_id", "__gl_item").agg(F.max(F.struct("n_match", (-F.col("n_region")).alias("less"))).alias("best"))
    return best.select(F.col("__gl_id").alias(id_col), F.col("__gl_item").alias(item_col), F.col("best.n_match").alias("n_match"), (-F.col("best.less")).alias("n_region"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, all columns as they were; rows without an id stay."""
    found = contaminated(docs, benchmark, id_col, **how)
    return c.without(docs, found.select(F.col(id_col).alias("__gl_id")).distinct(), id_col)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))


def _sql(masks=MASKS, min_percent=80, region=50, min_words=8) -> str:
    shortest = min(map(len, masks))
    norm = lambda t: f"list_filter(regexp_split_to_array(replace(translate(lower(coalesce({t}, '')), 'ς{_PUNCTUATION}', 'σ'), 'ß', 'ss'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    seed = lambda m: "concat_ws(chr(1), " + ", ".join([f"'{m}'", *[f"w[p + {k + 1}]" for k, b in enumerate(m) if b == "1"]]) + ")"
    seeds = lambda t, key: " union all ".join(
        [f"select {key}, p, w, {seed(m)} s from (select {key}, w, unnest(range(len(w) - {len(m)} + 1)) p from {t})" for m in masks]
        + [f"select {key}, 0, w, concat_ws(chr(1), 'whole', array_to_string(w, chr(1))) from {t} where len(w) between 1 and {shortest - 1}"]
    )
    return f"""
with d as (select doc_id, {norm("text")} w from documents where doc_id is not null),
i as (select item_id, {norm("text")} w from benchmark where item_id is not null),
ds as ({seeds("d", "doc_id")}), bs as ({seeds("i", "item_id")}),
h as (select distinct doc_id, item_id, ds.w dw, bs.w iw, ds.p - bs.p diag, least(len(bs.w), {region}) n, greatest(0, least(bs.p - least(len(bs.w), {region}) // 2, len(bs.w) - least(len(bs.w), {region}))) a from ds join bs using (s)),
m as (select doc_id, item_id, n, len(iw) t, len(list_filter(range(n), lambda k: diag + a + k >= 0 and dw[diag + a + k + 1] = iw[a + k + 1])) c from h)
select doc_id, item_id, cast(max(c) as integer) n_match, cast(arg_min(n, -c * 1000 + n) as integer) n_region from m where c * 100 >= n * (case when t < {min_words} then 100 else {min_percent} end) group by doc_id, item_id"""


SQL = _sql()
