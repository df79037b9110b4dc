"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades 0 to K - 1 are ordered; P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all thresholds t_1 < t_2 < ...
The query's grades: 0 acceptable, 1 of poor quality, 2 toxic.  The features are hashed, each is there or not: the words of a text
and their first letters; first letters that a share of its words begin with; and its shape (shares of symbols, capitals, repeated
words and table cells, each beyond fixed bounds).  Lexical features are chosen, and scaled, by the log odds they have for the
top grade in the labelled sample, shapes by none; all weights are signed.

Fitting uses at most ``sample`` labelled documents (a documented bound); scoring covers every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

FEATURE_BITS = 20
#: Labelled documents that a model is fitted on, at most.
SAMPLE = 6000
#: Lengths of the first letters of a word that are features, and the share of words from which they are a dense one.
PREFIXES, DENSE = (4, 5), 1 / 300
#: Bounds of the shares that are features of shape.
SHAPE_BOUNDS = (0.02, 0.1, 0.3)
#: Grades weigh by their number of rows to minus this power.
BALANCE = 0.5
_EDGES = " .,;:!?\"'()[]{}<>*#$%&|-_/\\"
_SYMBOLS = "#*$%&|<>!"
_CAPITALS = re.compile(r"[^\W\d_a-zà-öø-ÿ]{2,}")


def _number(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) >> (64 - FEATURE_BITS)


#: Features of shape, by kind and bound.
SHAPES = np.array([[_number(f"\1{kind}\1{k}") for k in range(len(SHAPE_BOUNDS))] for kind in ("symbols", "capitals", "repeats", "cells")])
_DENSE = np.uint64(0x9E3779B97F4A7C15)


class Features(dict):
    """Word to the numbers of its features; bounded."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        own = word.strip(_EDGES)
        names = [own, *(f"{own[:k]}\0{k}" for k in PREFIXES if len(own) >= k)] if own else []
        out = self[word] = tuple(map(_number, names))
        return out

    def of(self, text: str | None) -> np.ndarray:
        """The distinct features of a text, in ascending order.  Null and empty texts have none."""
        words = (text or "").lower().split()
        if not words:
            return np.empty(0, np.int64)
        own = np.fromiter(chain.from_iterable(map(self.__getitem__, set(words))), np.int64)
        found, times = np.unique(own, return_counts=True)
        dense = found[(times > 1) & (times >= DENSE * len(words))].astype(np.uint64)
        shares = np.array([
            sum(map(text.count, _SYMBOLS)) / len(text), len(_CAPITALS.findall(text)) / len(words),
            sum(map(eq, words, words[1:])) / len(words), text.count(" | ") / len(words),
        ])
        shape = SHAPES[shares[:, None] > np.array(SHAPE_BOUNDS)]
        return np.unique(np.concatenate([found, (c.mix(dense ^ _DENSE) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), shape]))


@dataclass
class Ordinal:
    """weights by feature (scaled), and the ordered thresholds; ``bias`` where nothing was learned."""

    weights: np.ndarray
    thresholds: np.ndarray

    def beyond(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold; sums to the expected grade."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -50, 50)))


def one_of_copies(rows: list[np.ndarray]) -> list[int]:
    """The first row of those that agree in three min-wise hashes: a group of near copies counts as evidence once."""
    seen, out = set(), []
    for i, x in enumerate(rows):
        key = tuple(int(c.mix(x.astype(np.uint64) + np.uint64(k << 40)).min()) for k in (1, 2, 3)) if len(x) else ()
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def likelihood(score: np.ndarray, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean weighted log likelihood of grades ``y``, and its gradients by score and by ``raw``: the first threshold and the logarithms of the steps."""
    t = np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])
    cum = np.concatenate([np.ones((len(y), 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - t, -50, 50))), np.zeros((len(y), 1))], axis=1)
    at = np.arange(len(y))
    p = np.maximum(cum[at, y] - cum[at, y + 1], 1e-9)
    slope = cum * (1 - cum)
    g_score = weight * (slope[at, y] - slope[at, y + 1]) / p / len(y)
    g_t = np.array([np.sum(weight * (np.where(y == k, slope[:, k + 1], 0) - np.where(y == k + 1, slope[:, k + 1], 0)) / p) for k in range(len(t))]) / len(y)
    g_raw = np.concatenate([[g_t.sum()], [g_t[k:].sum() * np.exp(raw[k]) for k in range(1, len(raw))]])
    return float(np.mean(weight * np.log(p))), g_score, g_raw


def chosen_features(flat: np.ndarray, row: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexical features that surely speak for the top grade, with their log odds; then those of shape, with 1.

    Sure: a log-likelihood ratio that chance hardly reaches among so many.  Words that lower grades share say nothing of a long text.
    """
    size = 1 << FEATURE_BITS
    bad, good = np.bincount(flat, top[row], size), np.bincount(flat, ~top[row], size)
    scale = np.log((bad + 0.5) / (top.sum() + 1) / ((good + 2) / ((~top).sum() + 4)))
    both, base = bad + good, top.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(bad > 0, bad * np.log(bad / (both * base)), 0) + np.where(good > 0, good * np.log(good / (both * (1 - base))), 0))
    sure = (scale > 0.5) & (ratio > 2 * np.log(max(2, np.sum(both >= 3))) - 4)
    shape = np.unique(SHAPES)
    sure[shape] = False
    lexical = np.flatnonzero(sure)
    return np.concatenate([lexical, shape]), np.concatenate([scale[lexical], np.ones(len(shape))])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = 300, decay: float = 1e-3) -> Ordinal:
    """Maximum likelihood with a Gaussian prior (lexical weights around naive Bayes, shapes around 0), by Adam over all rows; deterministic."""
    size = 1 << FEATURE_BITS
    y = np.asarray(grades, np.int64)
    if not len(y) or (y == y[0]).all():  # one grade only: predict it
        at = 30.0 if not len(y) or y[0] == 0 else -30.0
        return Ordinal(np.zeros(size, np.float32), np.linspace(at, at + 1, n_grades - 1))
    n = np.array([len(x) for x in rows])
    flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), n)
    used, value = chosen_features(flat, row, y == y.max())
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    keep = place[flat] >= 0
    flat, row = place[flat[keep]], row[keep]
    is_lexical = ~np.isin(used, SHAPES)
    prior = is_lexical.astype(float)
    w = prior.copy()
    share = np.array([np.clip((y > k).mean(), 1e-3, 1 - 1e-3) for k in range(n_grades - 1)])
    t = np.log(1 / share - 1)
    raw = np.concatenate([[t[0]], np.log(np.maximum(np.diff(t), 1e-2))])  # thresholds as a first one and positive steps
    weight = (1 / np.bincount(y, minlength=n_grades).clip(1) ** BALANCE)[y]
    weight /= weight.mean()
    m, v = np.zeros(len(w) + len(raw)), np.zeros(len(w) + len(raw))
    for step in range(1, steps + 1):
        _, g_score, g_raw = likelihood(np.bincount(row, (w * value)[flat], len(y)), raw, y, weight)
        grad = np.concatenate([np.bincount(flat, g_score[row], len(w)) * value + decay * (prior - w), g_raw])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, raw = w + move[: len(w)], raw + move[len(w) :]
    out = np.zeros(size, np.float32)
    out[used] = w * value
    return Ordinal(out, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))]))


def grade_of(toxic: Column, quality: Column) -> Column:
    """2: toxic; 1: of poor quality; 0: neither; null if toxicity is not known."""
    return F.when(toxic == 1, 2).when(toxic == 0, F.when(quality == 0, 1).otherwise(0))


def train(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_grades: int = 3, sample: int = SAMPLE) -> Ordinal:
    """``grades``: id_col and ``grade``; a document graded twice has the higher.  Takes at most ``sample`` of the least hashes of id."""
    chosen = grades.filter(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(id_col).agg(F.max("grade").alias("grade"))
    chosen = c.hash_sample(c.checkpointed(chosen), F.col(id_col), sample, [F.col(id_col)]).select(F.col(id_col).alias("__gl_id"), "grade")
    joined = docs.select(c.quoted(id_col).alias("__gl_key"), c.quoted(text_col).alias("__gl_text")).join(F.broadcast(chosen), F.col("__gl_key") == F.col("__gl_id"))  # sample rows at most
    found = joined.groupBy("__gl_id", "grade").agg(F.min("__gl_text").alias("__gl_text"))

    def featured(batches):
        f = Features()
        for b in batches:
            x = [f.of(t).astype(np.int32) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column(0).cast(pa.int64()), "grade": b.column(1).cast(pa.int32()), "x": [v.tobytes() for v in x]}, schema=c.arrow_schema(id=pa.int64(), grade=pa.int32(), x=pa.binary()))

    rows = found.select(F.col("__gl_id").cast("long"), F.col("grade").cast("int"), "__gl_text").mapInArrow(featured, "id long, grade int, x binary").collect()  # at most ``sample`` rows
    rows.sort(key=lambda r: r.id)
    features = [np.sort(np.frombuffer(r.x, np.int32).astype(np.int64)) for r in rows]
    chosen = one_of_copies(features)
    return fit([features[i] for i in chosen], np.array([rows[i].grade for i in chosen], np.int64), n_grades)


def score(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """Adds ``severity`` (the expected grade) and ``p_toxic`` (of the top grade); columns of those names are replaced, others stay.

    Null text scores as empty.  Texts of any length are read whole.  An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f, model = Features(), held.value
        for texts in batches:
            sums = np.array([model.weights[f.of(t)].sum(dtype=np.float64) for t in texts])
            p = model.beyond(sums)
            yield pd.DataFrame({"severity": p.sum(axis=1), "p_toxic": p[:, -1]})

    # postponed annotations are strings here, so the kind is told
    rate.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(rate, "severity double, p_toxic double")
    rated = docs.withColumn("__gl_rated", udf(c.quoted(text_col)))
    clash = [x for x in docs.columns if x not in ("severity", "p_toxic")]
    return rated.select(*[c.quoted(x) for x in clash], "__gl_rated.severity", "__gl_rated.p_toxic")


#: A document is rejected if its probability of the top grade is at least this.
REJECT = 0.5


def labelled(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", grade_of(F.col("toxic"), F.col("quality")).alias("grade")).filter(F.col("grade").isNotNull())


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, labelled(c.table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= REJECT).alias("rejected"))
