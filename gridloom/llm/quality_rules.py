"""Quality rules: a table of thresholds compiled into one projection, without user functions.

All figures of a text are expressions over its word and line arrays, so a corpus is judged in one narrow scan: no
shuffle, no join, no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

SYMBOLS = "#*$%&|<>"
# Very frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it with as was on are be this by from "
    "der die das und ist in den von zu mit nicht ein eine für auf im "
    "le la les des du de et est que en un une dans pour qui par sur pas avec "
    "el los las y que se por con para no del es lo su"
).split()
#: (figure, least, most): a text is kept if every figure lies within; None has no limit.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, 1_000_000),
    ("mean_word_chars", 2, 15),
    ("symbols_per_word", None, 0.5),
    ("stop_word_share", 0.02, None),
    ("dup_line_share", None, 0.5),
    ("repeat_word_share", None, 0.5),
)


def quality_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures of each text, with the id: one row for each row of ``docs``.

    n_words; word_chars (code points in words); n_symbols; n_lines (with a word); n_dup_lines (of these, equal to an
    earlier one); n_repeat_words (words in 3-word windows that occur twice or more in the text, the first included);
    n_stop_words.  Null and empty texts have zeros; ids may be null or repeat; other columns are not touched.
    """
    text, w, s, d = F.col("__gl_text"), F.col("__gl_words"), F.col("__gl_sorted"), F.col("__gl_dup")
    n = F.size(w)
    blank = lambda x: F.length(F.translate(x, c.SPACE_CHARS, ""))
    base = docs.select(c.quoted(id_col).alias("__gl_id"), F.coalesce(c.quoted(text_col), F.lit("")).alias("__gl_text"))
    base = base.select("*", c.words_of(text).alias("__gl_words"), F.filter(F.split(text, "\n"), lambda x: blank(x) > 0).alias("__gl_lines"))
    # Windows by hash; those whose hash repeats, with their words, sorted again: equal windows are neighbours, whatever their hashes.
    key = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))
    base = base.withColumn("__gl_sorted", F.when(n >= 4, F.sort_array(key)))
    near = lambda x, i, of, eq: eq(x, F.get(of, F.when(i > 0, i - 1))) | eq(x, F.get(of, i + 1))
    like = F.filter(s, lambda x, i: near(x, i, s, lambda x, y: x["h"] == y["h"]))
    worded = F.transform(like, lambda x: F.struct(F.get(w, x["at"]).alias("a"), F.get(w, x["at"] + 1).alias("b"), F.get(w, x["at"] + 2).alias("c"), x["at"].alias("at")))
    base = base.withColumn("__gl_dup", F.sort_array(worded))
    again = F.filter(d, lambda x, i: near(x, i, d, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])))
    base = base.withColumn("__gl_at", F.coalesce(F.sort_array(F.transform(again, lambda x: x["at"])), F.array().cast("array<int>")))
    p = F.col("__gl_at")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.col("__gl_lines")
    return base.select(
        F.col("__gl_id").alias(id_col),
        n.cast("long").alias("n_words"),
        blank(text).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


FIGURES = {
    "n_words": F.col, "mean_word_chars": lambda _: _ratio("word_chars", "n_words"), "symbols_per_word": lambda _: _ratio("n_symbols", "n_words"),
    "stop_word_share": lambda _: _ratio("n_stop_words", "n_words"), "dup_line_share": lambda _: _ratio("n_dup_lines", "n_lines"), "repeat_word_share": lambda _: _ratio("n_repeat_words", "n_words"),
}


def verdict(rules=RULES) -> Column:
    """The table of thresholds as one boolean expression over the figures."""
    out = F.lit(True)
    for name, least, most in rules:
        x = FIGURES[name](name)
        out = out if least is None else out & (x >= least)
        out = out if most is None else out & (x <= most)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``quality_figures`` and the boolean ``kept``.  A text without words fails any least number of words."""
    return quality_figures(docs, id_col, text_col).withColumn("kept", verdict(rules))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(c.table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


_STOPS = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
SQL = f"""
with t as (select doc_id, coalesce(text, '') as x, row_number() over () as r from documents),
w as (select doc_id, r, x, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') as ws,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as ls from t),
g as (select r, p, concat_ws(chr(1), ws[p], ws[p + 1], ws[p + 2]) as k from (select r, ws, unnest(range(1, len(ws) - 1)) as p from w)),
d as (select r, p from (select r, p, count(*) over (partition by r, k) as n from g) where n >= 2),
u as (select r, count(distinct p + o) as n from d, (values (0), (1), (2)) as s(o) group by r),
f as (select doc_id, len(ws) as n_words, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
        length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(u.n, 0) as n_repeat_words,
        len(list_filter(ws, lambda v: lower(v) in ({_STOPS}))) as n_stop from w left join u using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and n_words >= 50 and n_words <= 1000000 and word_chars / n_words >= 2 and word_chars / n_words <= 15 and n_symbols / n_words <= 0.5
    and n_stop / n_words >= 0.02 and (case when n_lines > 0 then n_dup_lines / n_lines else 0 end) <= 0.5 and n_repeat_words / n_words <= 0.5 as kept
from b"""
